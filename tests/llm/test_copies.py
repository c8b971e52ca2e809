"""Near copies, shared passages, media chunks and benchmark passages, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import CLASHING, WORD, edge_rows, edge_table, empty_table, lower, prose
from pyspark.sql import functions as F

from zonehour.llm import components, decontaminate, media, simhash, substring
from zonehour.llm.common import staged


def parts(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 12), (200, 190)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(300, 340)]
        df = spark.createDataFrame(pairs, "a long, b long")
        want = parts(pairs, {x for p in pairs for x in p})
        got = {r.node: r.component for r in components.components(df).collect()}
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {k: v for k, v in want.items() if k in linked}


def brute_fingerprint(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_components(spark):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in edge_rows()]
    base = [prose(rng, 200) for _ in range(20)]
    for k in range(150):
        w = base[k % 20].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = "new"
        rows.append((100 + k, " ".join(w)))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    of = np.array(fps, np.uint64)
    pairs = [(i, j) for i in range(len(of)) for j in np.flatnonzero(np.bitwise_count(of ^ of[i]) <= 3).tolist()]
    top = parts(pairs, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(least.get(top[i], d), d)
    want = sorted(((d, f"{f:016x}", least.get(top[i])) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 50)
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**62, 4)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(60, k, replace=False)) for c in center for k in (0, 1, 1, 2, 2, 2) for _ in range(40)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in components.components(simhash.near_links(df)).collect()}
    a = np.array(fps, np.uint64)
    pairs = [(fps[i], fps[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist()]
    assert {f: got.get(f, f) for f in fps} == parts(pairs, fps)
    assert simhash.near_links(df).count() < 60 * len(fps)


def test_one_of_each(spark):
    rng = random.Random(6)
    text = prose(rng, 300, 10_000)
    near = text.split()
    for k in (50, 200):
        near[k] = "changed"
    far = [prose(rng, 300, 10_000) for _ in range(5)]
    rows = [(5, " ".join(near)), (3, text), (3, text), (9, text.upper()), (None, text), *[(20 + k, t) for k, t in enumerate(far)], (30, None), (31, ""), (None, "alone words here")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([3, 20, 21, 22, 23, 24, 30, None], key=repr)
    assert simhash.one_of_each(empty_table(spark)).count() == 0
    d = edge_table(spark, clashing=True)
    assert simhash.one_of_each(d).columns == d.columns


def test_recall_of_wide_fingerprints():
    """Of texts of 0.8 similarity and more, nearly all share a piece and lie within the radius."""
    rng = random.Random(9)
    near = shared = 0
    for _ in range(150):
        w = prose(rng, rng.randint(30, 400), 10_000).split()
        v = list(w)
        for _ in range(max(1, len(w) // 60)):
            v[rng.randrange(len(v))] = "zz"
        s = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v)]
        if len(s[0] & s[1]) / len(s[0] | s[1]) < 0.8:
            continue
        (a, p), (b, q) = (simhash.wide_fingerprint(" ".join(x).encode()) for x in (w, v))
        near += 1
        shared += bool(set(p.tolist()) & set(q.tolist())) and int(np.bitwise_count(a ^ b).sum()) <= simhash.WIDE_RADIUS
    assert near > 80 and shared / near > 0.95


def jaccard(a, b):
    s = [{tuple(x.split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))} for x in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_one_of_each_goes_by_similarity(spark, monkeypatch):
    """Pairs of less than 0.8 similarity both stay, those of more don't; also where a group is cut into tiles."""
    rng = random.Random(12)
    rows, gone, below = [], set(), 0
    for k in range(120):
        w = prose(rng, 200, 10_000).split()
        v = list(w)
        for c in range(3 + k % 7):
            v[(c + 1) * 19] = "zz"
        a, b = " ".join(w), " ".join(v)
        rows += [(2 * k, a), (2 * k + 1, b)]
        gone |= {2 * k + 1} if jaccard(a, b) >= 0.8 else set()
        below += 0.6 < jaccard(a, b) < 0.8
    hot = prose(rng, 200, 10_000).split()
    rows += [(1000 + k, " ".join([*hot[:k], "yy", *hot[k + 1 :]])) for k in range(40)]
    gone |= set(range(1001, 1040))
    assert below > 40
    monkeypatch.setattr(simhash, "SETS", 8)
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, _ in rows} - gone


def test_links_within_a_component_of_unlike_texts(spark, monkeypatch):
    """What is not linked to a component's leader is compared with all others, tile by tile."""
    rng = random.Random(21)
    texts = []
    for k in range(30):
        w = prose(rng, 60, 10_000).split()
        for c in range(k % 3 + 1):
            texts.append(" ".join([*w[: 58 - c], "zz", *w[59 - c :]]))
    of = [jaccard_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(of)) for j in range(i) if len(of[i] & of[j]) >= 0.8 * len(of[i] | of[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    monkeypatch.setattr(simhash, "SETS", 4)
    nodes = df.select(F.col("t").alias("node"), "t", F.lit(7).cast("long").alias("component"))
    got = [(r.a, r.b) for r in simhash.similar_links(nodes, df).collect()]
    assert len(pairs) > 20 and set(map(frozenset, got)) <= set(map(frozenset, pairs))
    assert parts(got, range(len(texts))) == parts(pairs, range(len(texts)))


def jaccard_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_a_line_that_many_short_texts_share_is_no_key(spark):
    """Short texts of one licence line: no key has many of them, as long as they have more words of their own; near copies among them are found."""
    rng = random.Random(31)
    line = " ".join(f"licence{k}" for k in range(30))
    texts = [line + " " + prose(rng, 20, 100_000) for _ in range(3000)]
    near = [t.rsplit(" ", 1)[0] + " zz" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string").repartition(4)
    fps = simhash._with_wide(df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text"), 5)
    keys = simhash.candidate_keys(staged(fps, "keys"))
    per = keys.groupBy("key").count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    assert per.most < simhash.FREQUENT and per.rows <= 5 * 3040 * 2
    sent = keys.groupBy("node").count().agg(F.max("count")).first()[0]
    assert sent <= 46 // 5 + 1
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == set(range(3000))


def test_recall_of_short_texts():
    """Texts of 5 to 100 words of 0.8 similarity and more share a key and are candidates."""
    rng = random.Random(10)
    near = 0
    for k in range(6000):
        w = prose(rng, 5 + k % 36 if k % 3 else rng.randint(40, 100), 10_000).split()
        v = list(w)
        if k % 2:
            v += prose(rng, rng.randint(1, max(1, len(w) // 4)), 10_000).split()
        else:
            v[rng.choice([0, -1])] = "zz"
        if len(w) < 5 or jaccard(" ".join(w), " ".join(v)) < 0.8:
            continue
        (a, p), (b, q) = (simhash.wide_fingerprint(" ".join(x).encode()) for x in (w, v))
        near += 1
        assert set(p.tolist()) & set(q.tolist()) or len(w) - 4 > simhash.SMALL
        assert int(np.bitwise_count(a ^ b).sum()) <= simhash.WIDE_RADIUS + 8
    assert near > 1500


def test_media_round_trip(spark):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(50, "é" * 96), (51, "x" * 192), (52, "x" * 193), (53, prose(rng, 9000)), (54, "ins " + prose(random.Random(3), 9000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = media.media_column(df).collect()
    assert len(got) == len(rows)
    features = {}
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 if b else 192)
        m = b"P5\n192 %d\n255\n" % (len(p) // 192) + p
        want.setdefault(d, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    for r in got:
        assert tuple(r)[1:7] in want[r.doc_id]
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature
    assert media.media_column(empty_table(spark)).count() == 0
    assert media.media_column(edge_table(spark, clashing=True)).count() == len(edge_rows())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("zonehour_chunks")]


def brute_feature(text):
    """Mean, deviation, extremes, entropy of the bytes and steps along rows of 192, with nothing but Python."""
    b = text.encode()
    b += b" " * (-len(b) % 192 if b else 192)
    n = collections.Counter(b)
    mean = sum(b) / len(b)
    std = math.sqrt(sum(x * x for x in b) / len(b) - mean * mean)
    entropy = -sum(c / len(b) * math.log2(c / len(b)) for c in n.values())
    steps = sum(abs(b[k] - b[k - 1]) for k in range(len(b)) if k % 192)
    return [len(b) // 192, mean, std, min(b), max(b), entropy, steps]


def test_media_features_and_hot_chunks(spark, monkeypatch):
    """One text in most rows, and one chunk in many texts: as many rows, whatever one task may do."""
    monkeypatch.setattr(media, "HOT_ROWS", 7)
    rng = random.Random(21)
    common = prose(rng, 4000)
    texts = [common + f" {k}" for k in range(40)] + [f"short {k % 3}" for k in range(60)] + ["", "ÿ" * 300]
    got = {r.doc_id: r for r in media.media_column(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        f = dict(x.split("=") for x in got[k].feature.split(";"))
        assert list(f) == ["rows", "mean", "std", "min", "max", "entropy", "steps"]
        assert [float(v) for v in f.values()] == pytest.approx(brute_feature(t), abs=6e-5)


def test_missing_and_damaged_chunks_are_errors(spark):
    df = spark.createDataFrame([(1, "one small text"), (2, prose(random.Random(5), 3000))], "doc_id long, text string")
    found, lists = media.chunks(df), staged(media.recipes(df), "lists")
    store = media.write_store(spark, found)
    assert media.read_media(store, lists).count() == 2
    for n in ("n = 1", "n > 1"):
        lost = lists.where(n).select("digest").limit(1)
        with pytest.raises(Exception, match="is missing"):
            media.read_media(store.join(lost, "digest", "left_anti"), lists).collect()
    media.drop_store(store)


def test_cuts_move_only_near_an_insertion():
    raw = prose(random.Random(7), 30_000).encode()
    one, two = (media.to_media(media.pad(x)) for x in (raw, raw[:50_000] + b"inserted" + raw[50_000:]))
    pieces = [{m[a:b] for a, b in zip([0, *e], e, strict=False)} for m, e in zip((one, two), media.cuts([one, two]), strict=True)]
    assert len(pieces[0]) > 20 and len(pieces[0] & pieces[1]) >= len(pieces[0]) - 4
    assert all(len(p) <= media.MOST for p in pieces[0])


def brute_repeats(rows, window=50):
    least, out = {}, []
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_against_brute_force(spark):
    rng = random.Random(2)
    common = prose(rng, 70)
    rows = [(r[0], r[1]) for r in edge_rows()]
    for k in range(60):
        t = [prose(rng, rng.randint(0, 90)) for _ in range(3)]
        rows.append((100 + k // 2 * 2 + (k % 3 == 0), " ".join([t[0], common if k % 2 else t[1], t[2], common[: len(common) // 2] if k % 5 == 0 else ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert substring.remove_repeats(empty_table(spark)).count() == 0
    assert substring.remove_repeats(edge_table(spark, clashing=True)).count() == len(edge_rows())


def test_substring_of_large_partitions_and_forgetting(spark, monkeypatch):
    """Partitions that get the whole window as their prefix, tasks that forget, and trees of few rows at a time."""
    rng = random.Random(4)
    line = prose(rng, 20)
    rows = [(k, " ".join([prose(random.Random(k % 7), 60), line, prose(random.Random(k % 5), 60)])) for k in range(40)]
    rows += [(50 + k, " ".join(["x y"] * (60 + k))) for k in range(4)]
    want = brute_repeats(rows)
    monkeypatch.setattr(substring, "REMEMBERED", 5)
    monkeypatch.setattr(substring, "ROWS", 3)
    for most in (0, 60, 10**6):
        monkeypatch.setattr(substring, "PARTITION", most)
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == want


def test_substring_of_repeated_lines(spark):
    """A run of one partition spans many windows where a line recurs; a word changed in its middle stays."""
    rng = random.Random(8)
    rows = []
    for k in range(0, 60, 2):
        w = (prose(rng, 20) + " ").split() * 10
        v = list(w)
        v[100] = "changed"
        rows += [(k, " ".join(w)), (k + 1, " ".join(v))]
    line = prose(rng, 12)
    between = [[prose(rng, 5) for _ in range(15)] for _ in range(2)]
    between[1] = [*between[0][:7], between[1][7], *between[0][8:]]
    rows += [(100 + k, " ".join(f"{line} {x}" for x in b)) for k, b in enumerate(between)]
    want = brute_repeats(rows)
    assert all("changed" in r[3] for r in want if r[0] < 60 and r[0] % 2)
    for parts in (1, 2, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()), key=repr) == want


def test_substring_with_text_ids(spark):
    rng = random.Random(3)
    same = prose(rng, 80)
    rows = [("b", prose(rng, 20) + " " + same), ("ä", same), ("a10", same + " " + prose(rng, 70)), ("a9", same + " end"), (None, same)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {"a10": 0, "a9": 80, "b": 80, "ä": 80, None: 0}


def test_deep_nodes():
    """Equal nodes exactly where the words to that depth are equal."""
    rng = random.Random(5)
    words = np.array([rng.randrange(3) for _ in range(400)])
    for depth in (1, 2, 3, 5, 8, 13):
        at = np.arange(len(words) - depth + 1)
        node = substring.deep_nodes(words, at, depth)
        of = {}
        assert all(of.setdefault(tuple(words[k : k + depth]), n) == n for k, n in zip(at, node.tolist())) and len(set(of.values())) == len(of)


def test_decontamination_against_edit_distance(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(12, 50), 3000)) for k in range(25)] + [(90, None), (91, ""), (92, "two words")]
    rows, planted = [(r[0], r[1]) for r in edge_rows()], []
    for k, t in items[:25]:
        n = len(t.split())
        for share in (0, 0.5, 1.0):
            w = t.split()
            for _ in range(int(share * (n // 5))):
                p = rng.randrange(len(w))
                w[p : p + rng.choice([0, 1])] = ["other%d" % rng.randrange(99)]
            rows.append((1000 + len(rows), prose(rng, 40, 3000) + " " + " ".join(x.upper() + "," for x in w) + " " + prose(rng, 40, 3000)))
    rows += [(5000, "so two, words."), (5001, "two other words")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(df, bench).collect()}
    for d, t in rows:
        w = decontaminate.Words([decontaminate.normal(t)]).hash
        for i, s in items:
            item = decontaminate.Words([decontaminate.normal(s)]).hash
            if len(item):
                e, _ = decontaminate.edits_within(item, w)
                if e <= len(item) // 5:
                    planted.append((d, i))
                    assert (d, i) not in got or got[d, i].edits >= e
                else:
                    assert (d, i) not in got
    assert len(planted) > 70 and np.mean([p in got for p in planted]) > 0.98
    clean = {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_edges(spark, monkeypatch):
    bench = spark.createDataFrame([], "item_id long, text string")
    d = edge_table(spark, clashing=True)
    assert decontaminate.find_overlaps(d, bench).count() == 0
    assert decontaminate.decontaminated(d, bench).count() == len(edge_rows())
    some = spark.createDataFrame([(k, r[1][:200]) for k, r in enumerate(edge_rows()) if r[1]], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_overlaps(d, some).collect()), key=repr)
    assert whole and decontaminate.decontaminated(empty_table(spark), some).count() == 0
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 400)  # a benchmark in shards
    assert sorted(map(tuple, decontaminate.find_overlaps(d, some).collect()), key=repr) == whole


def test_recall_by_length(tmp_path):
    """Of items of 3 to 2,000 words with as many random edits as are allowed, 95 % and more are found at every length."""
    rng = random.Random(15)
    for n in (3, 4, 5, 6, 8, 10, 12, 15, 20, 30, 45, 60, 90, 128, 129, 200, 400, 800, 1500, 2000):
        items = [prose(rng, n, 3000) for _ in range(60 if n < 400 else 40)]
        decontaminate._write(str(tmp_path / str(n)), 0, items)
        found = decontaminate.Index(str(tmp_path / str(n)), 1, 0.8)
        texts = []
        for t in items:
            w = t.split()
            for _ in range(n // 5):
                p = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[p : p + (kind > 0)] = ["other%d" % rng.randrange(99)] * (kind < 2)
            texts.append(decontaminate.normal(prose(rng, 30, 3000) + " " + " ".join(w) + " " + prose(rng, 30, 3000)))
        got = {(h.doc, h.item) for _, hits in found.hits(texts) for h in hits}
        assert len({d for d, i in got if d == i}) >= 0.95 * len(items), n


def test_edits_of_a_long_item_may_lie_together(tmp_path):
    """A fifth of a long item replaced at its beginning, middle or end; what goes beyond isn't found."""
    rng = random.Random(16)
    items = [prose(rng, 700, 3000) for _ in range(12)]
    decontaminate._write(str(tmp_path), 0, items)
    found = decontaminate.Index(str(tmp_path), 1, 0.8)
    w = [t.split() for t in items]
    at = [(0, 280, 559)[k % 3] for k in range(12)]
    texts = lambda n: [decontaminate.normal("before " + " ".join([*x[:a], *(["other"] * n), *x[a + n :]]) + " behind") for x, a in zip(w, at, strict=True)]
    got = [(h.doc, h.item, h.start, h.end, h.edits) for _, hits in found.hits(texts(140)) for h in hits]
    assert {(d, i) for d, i, *_ in got} == {(k, k) for k in range(12)} and all(e == 140 for *_, e in got)
    assert not list(found.hits(texts(141)))
    whole = [h for _, hits in found.hits([decontaminate.normal(" ".join([*w[0], "x", *w[0]]))]) for h in hits]
    assert [(h.item, h.start, h.end, h.edits) for h in whole] == [(0, 0, 700, 0)]


def test_pieces_cover_items():
    size = np.array([0, 1, 128, 129, 256, 257, 1999])
    item, offset, words = decontaminate.pieces(size)
    assert words.max() <= decontaminate.PIECE and set(item) == {1, 2, 3, 4, 5, 6} and (words[item > 2] >= decontaminate.PIECE // 2).all()
    for k in range(1, 7):
        o, n = offset[item == k], words[item == k]
        assert o[0] == 0 and (np.diff(o) - n[:-1]).min(initial=0) >= 0 and (np.diff(o) - n[:-1]).max(initial=0) <= 1 and 0 <= size[k] - o[-1] - n[-1] <= 1


def test_decontamination_with_text_ids(spark):
    item = prose(random.Random(1), 20)
    docs, bench = spark.createDataFrame([("d1", "x " + item)], "doc_id string, text string"), spark.createDataFrame([("q-1", item)], "item_id string, text string")
    assert [tuple(r)[:5] for r in decontaminate.find_overlaps(docs, bench).collect()] == [("d1", "q-1", 1, 21, 0)]


def test_oracle_of_substring(spark):
    from zonehour.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    rows = brute_repeats([(k, prose(random.Random(k % 4), 80)) for k in range(12)])
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, prose(random.Random(k % 4), 80)) for k in range(12)])
    got = con.execute(ORACLE_SQL["op7_substring"]).fetchall()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((r[0], r[1], r[2]) for r in rows)
    assert F is not None and CLASHING
