"""Periodic runs, toxicity and turn repair, against brute force or held-out rows."""

import binascii
import collections
import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pytest
from helpers import CLASHING, WORD, edge_rows, edge_table, empty_table
from pyspark.sql import functions as F

from zonehour.llm import queries, runs, toxicity, turns

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- periodic runs ------------------------------------------------------------


def brute_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def run_texts(rng):
    for _ in range(150):
        alphabet = rng.choice(["a", "ab", "abc", "abcdefgh"])
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            cycle = [rng.choice(alphabet) for _ in range(rng.randint(1, 7))]
            k = rng.randint(0, len(w))
            w[k:k] = (cycle * 9)[: rng.randint(1, 9 * len(cycle))]
        yield rng.choice([" ", "\n", " \t "]).join(w)


def test_runs_against_brute_force(spark):
    texts = [r[1] if r[1] is None or len(r[1]) < 5000 else r[1][:3000] for r in edge_rows()] + list(run_texts(random.Random(2))) + ["x y z " * 9, "A a " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in runs.periodic_runs(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        want = brute_runs(words)
        assert [tuple(r) for r in got[k].runs] == want, t
        assert got[k].n_words == len(words) and got[k].kept == brute_kept(words, want)


def test_runs_of_other_powers():
    rng = random.Random(5)
    for times, least in ((3, 3), (3, 7), (5, 5)):
        for t in itertools.islice(run_texts(rng), 60):
            w = WORD.findall(t)
            names = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, np.int64)
            place, length, period = runs.find_runs(names, np.zeros(len(w), np.int64), len(w), least, times)
            assert list(zip(place.tolist(), length.tolist(), period.tolist(), strict=True)) == brute_runs(w, least, times)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(4, np.int64), np.zeros(4, np.int64), 4, 4, 2)


def brute_cycled(doc_id, text):
    w = WORD.findall(text or "")
    h = binascii.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def test_run_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None if k == 7 else k, t) for k, t in enumerate([None, "", " ", *run_texts(rng), *run_texts(rng)])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 50
    for k, t in rows:
        w, r = brute_cycled(k, t), got[k]
        want = brute_runs(w)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert r.runs_sha256 == SHA("".join(f"{s},{n},{q}\n" for s, n, q in want)) and r.collapsed_sha256 == SHA(brute_kept(w, want))


def test_runs_take_edges(spark):
    assert runs.periodic_runs(empty_table(spark)).collect() == []
    x = edge_table(spark).withColumns({c: F.lit("x") for c in ("runs", "kept", "n_words", "id")})
    got = runs.periodic_runs(x)
    assert got.columns == ["doc_id", "n_words", "runs", "kept"] and got.count() == len(edge_rows())


# --- toxicity -----------------------------------------------------------------

RUDE = ["idiot", "stupid", "loser"]


def labelled(rng, n, rude=RUDE):
    for k in range(n):
        w = [rng.choice("aeiou") + str(rng.randrange(300)) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", "!", ","]))
        yield k, " ".join(w), int(toxic)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def encoded(texts):
    return [t.encode() for t in texts]


def test_toxicity_held_out_and_hidden():
    rows = list(labelled(random.Random(1), 1500))
    m = toxicity.fit(encoded(t for _, t, _ in rows[:1000]), np.array([y for *_, y in rows[:1000]]))
    assert (m.lexicon.look_words(RUDE) > 0).all()
    y = np.array([y for *_, y in rows[1000:]])
    s = m.score(encoded(t for _, t, _ in rows[1000:]))
    assert auc(s, y) > 0.99 and ((s >= 0.3) == y).mean() > 0.98 and s.min() >= 0 and s.max() <= 1
    clean = "a1 e2 i3 o4 u5 " * 4
    assert m.score(encoded([clean]))[0] < 0.3 <= m.score(encoded([clean + "IDIOT!!! e7"]))[0]
    f = toxicity.features(m.lexicon, encoded([clean, *(clean + w for w in ("1d1ot e7", "st*upid", "i d i o t e7", "idiooot", "l0ser!", "$tupid"))]))
    assert f[0, 3] == 0 and (f[1:, 3] > 0).all() and (f[1:, 7] > 0).all()


def test_features_by_hand():
    f = toxicity.features(toxicity.Lexicon.of({"idiot": 3.0, "^stup": 2.0, "müll": 1.0}), encoded(["You IDIOT!! stupidly so", "", "one two you", "a b é", "“MÜLL” 3 ÉtÉ"]))
    at = {n: k for k, n in enumerate(toxicity.FEATURES)}
    assert f[0, at["word_density"]] == 1 / 4 and f[0, at["stem_density"]] == 1 / 4 and f[0, at["most_odds"]] == 3 and f[0, at["odds_per_word"]] == 5 / 4
    assert f[0, at["near_you"]] == pytest.approx((1 / 2 + 1 / 3) / 4) and f[0, at["you_density"]] == 1 / 4
    assert f[0, at["capitals"]] == pytest.approx(6 / 18) and f[0, at["shouted"]] == 1 / 4 and f[0, at["loud_marks"]] == 2 / 4
    assert not f[1].any() and f[2, at["near_you"]] == 0 and f[3, at["alone"]] == 1
    assert f[4, at["word_hits"]] == np.log1p(1) and f[4, at["capitals"]] == 6 / 7 and f[4, at["shouted"]] == 1 / 3 and f[4, at["other_marks"]] == 2 / 3


def test_lexicon_counts_documents():
    texts = encoded(["bad bad word", "bad stem1", "word", "word other", "bad"] * 100)
    y = np.array([1, 1, 0, 0, -1] * 100)
    doc, term = toxicity.terms(texts)
    lex = toxicity.learn_lexicon(doc, term, y)
    assert lex.look_words(["bad"])[0] == pytest.approx(np.log(200.5 / 201) - np.log(0.5 / 201)) and lex.look_words(["word", "other", "absent"]).tolist() == [0, 0, 0]


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = rng.integers(1, 25)
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n)
        at, value = toxicity.isotonic(x, y)
        fitted = np.interp(x, at, value)
        # Min-max formula over the distinct places.
        u = np.unique(x)
        mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
        want = {v: max(min(mean(a, b) for b in u[u >= v]) for a in u[u <= v]) for v in u}
        assert np.allclose(fitted, [want[v] for v in x])


def test_boosting_lowers_the_loss_and_keeps_rare_rates_apart():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.where(rng.random(3000) < 0.05, rng.random(3000), 0), rng.random(3000)])
    y = (x[:, 0] > 0).astype(int)
    p = 1 / (1 + np.exp(-toxicity.boost(x, y).margin(x)))
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.05


def test_toxicity_learns_from_what_it_may(spark):
    rows = list(labelled(random.Random(7), 900))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(3, "again"), (None, "x"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y if k % 3 else 1 - y) for k, _, y in rows] + [(None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumns({c: F.lit("x") for c in CLASHING + ["predicted"]}), m).collect()}
    assert len(got) == len(rows) + 2
    assert np.mean([got[k].predicted == y for k, _, y in rows if k % 3 == 0 and k != 3]) > 0.97
    s = toxicity.sample(docs, labels.unionAll(labels), F.lit(True), "doc_id", "text", "toxic", 50).collect()
    assert len(s) == 50 and len({r.id for r in s}) == 50


def test_toxicity_takes_edges(spark):
    m = toxicity.learn(edge_table(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(edge_table(spark), m).collect()} == {0.5}
    rows = list(labelled(random.Random(3), 400))
    m = toxicity.fit(encoded(t for _, t, _ in rows), np.array([y for *_, y in rows]))
    got = toxicity.score_toxicity(edge_table(spark, clashing=True), m)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(edge_rows())
    assert toxicity.score_toxicity(empty_table(spark), m).collect() == []
    assert len({r.score for r in got.where("doc_id in (0, 1, 2)").collect()}) == 1
    assert toxicity.fit([b"a"], np.array([1])).score([b"b", b""]).tolist() == [2 / 3, 2 / 3]


# --- turn repair --------------------------------------------------------------


def brute_parse(symbols):
    """Least (cost, audit, roles) by Dijkstra over places and states of the regular language, audits compared whole."""
    # 0 nothing yet, 1 after s, 2 after u, 3 after a
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", (), 0, 0)], set()
    while heap:
        cost, audit, roles, k, q = heapq.heappop(heap)
        if k == len(symbols) and q in (0, 3):
            return cost, audit, [r for r in roles if r]
        if (k, q) in done:
            continue
        done.add((k, q))
        for r in "ua":
            if (q, r) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", (*roles, r), k, step[q, r]))
        if k < len(symbols):
            c = symbols[k]
            heapq.heappush(heap, (cost + 2, audit + "D", (*roles, ""), k + 1, q))
            if c != "x":
                more = 5 if c == "!" or c.isupper() else 0
                for r in "sua":
                    if (q, r) in step and (r == c.lower() or r != "s"):
                        heapq.heappush(heap, (cost + more + (r != c.lower()), audit + ("K" if r == c.lower() else "R"), (*roles, r), k + 1, step[q, r]))


def test_parse_against_dijkstra():
    rng = random.Random(6)
    cases = ["", *("".join(p) for n in range(1, 4) for p in itertools.product("suaSUA?!x", repeat=n)), *("".join(rng.choice("suauauaUAx?") for _ in range(rng.randint(4, 24))) for _ in range(1500))]
    for s in cases:
        cost, edits, tail = turns.parse(s)
        audit = "".join("I" * len(e.inserted) + e.action for e in edits) + "I" * len(tail)
        said = "".join(e.inserted + e.role for e in edits) + tail
        want = brute_parse(s)
        assert (cost, audit, list(said)) == (want[0], want[1], want[2]), s
        assert re.fullmatch("(s?(ua)+)?", said)


def test_parse_of_a_long_conversation():
    cost, edits, tail = turns.parse("s" + "ua" * 50_000 + "a")
    assert cost == 2 and sum(e.action == "D" for e in edits) == 1 and not tail


def brute_conversations(rows):
    """rows: (conv, turn, role, text) in the order of the contract."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    blank, end = re.compile(r"[\x20\x09-\x0D]*"), re.compile(r".*[.!?][\x20\x09-\x0D]*", re.S)
    out = {}
    for conv, mine in by.items():
        kept = []
        for _, t, role, text in mine:
            h = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        n, seen, symbols = collections.Counter(), set(), ""
        for _, role, text in kept:
            fault = "blank" if blank.fullmatch(text) else "duplicate" if (role, text) in seen else "" if end.fullmatch(text) else "truncated"
            seen.add((role, text))
            n[fault] += 1
            s = role[:1] if role[:1] in ("s", "u", "a") else "?"
            symbols += "x" if fault in ("blank", "duplicate") else {"?": "!"}.get(s, s.upper()) if fault else s
        cost, audit, roles = brute_parse(symbols)
        places = [t for t, *_ in kept if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        lines, given, k = [], iter(roles), 0
        for c in audit:
            if c == "I":
                lines.append({"u": "user", "a": "assistant"}[next(given)] + ":")
                continue
            if c != "D":
                r = next(given)
                lines.append((kept[k][1] if c == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + kept[k][2])
            k += 1
        out[conv] = (max(places) - min(places) + 1 - len(set(places)) if places else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, SHA("\n".join(lines)))
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_turns(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in queries.op13_turn_repair(spark, str(folder)).collect()}
    want = brute_conversations([r[:4] for r in rows])
    assert got == want


def test_turn_repair_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = ["yes.", "no!", "why?", "so", "", " \t", "Well. \n", None, "a.b"]
    rows = []
    for conv in [*range(120), None]:
        for t in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "uncle", ""]), rng.choice(words), "x"))
    check_turns(spark, tmp_path, rows)


def test_turn_repair_of_one_large_conversation(spark, tmp_path, monkeypatch):
    """Blocks of a few rows, so that one conversation spans many of them."""
    monkeypatch.setattr(turns, "BLOCK", 8)
    rng = random.Random(10)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", f"text {t}."]), "x") for t in range(1500)]
    check_turns(spark, tmp_path, rows + [(2, 0, "user", "hello.", "x")])


def test_turn_repair_without_rows(spark, tmp_path):
    dropped = next(k for k in range(1000) if binascii.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "hello.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    r = queries.op13_turn_repair(spark, f"{tmp_path}/a").collect()
    assert [tuple(x) for x in r] == [(dropped, 0, 0, 0, 0, 0, 0, "", SHA(""))]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op13_turn_repair(spark, f"{tmp_path}/b").collect() == []


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    found = turns.repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = [(r.role, r.text) for r in found.turns.orderBy("conv_id", "place").collect()]
    assert got == [("user", "Why?"), ("assistant", "So.")] and found.conversations.first().audit == "DKDK"


