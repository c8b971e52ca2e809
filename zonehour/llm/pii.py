"""Surrogates for personal data, by DataFrame functions only.

One pattern finds entities of all kinds. An entity's canonical form (a phone's
digits, a lower-cased address, each word of a name) gets a keyed replacement of
its kind: digits become digits, letters letters of the same script, a card
number keeps its issuer digit and check rule, an address its top domain, a name
its gender. The replacement is rendered in the form that the entity was written
in, so that all spellings of one entity lead to one surrogate.

Two canonical forms must not share a surrogate, nor may a surrogate be some real
entity of the table: such candidates are drawn again under the next attempt
number, until none collides. Names get as many syllables as the number of names
of their kind asks for, and every kind's forms grow with the attempt, so that no
table can use them up.

Names are found behind a form of address. Where a document has such a name, its
words are replaced wherever they stand in that document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonehour.llm.common import staged

#: Forms of address by gender, as patterns; particles of names; words that begin sentences and titles of works but no second name; given names by script and gender.
TITLES = {
    "m": [r"Mr\.?", r"mr\.", r"MR\.?", "Herr", "HERR", "Monsieur", r"M\.", "Señor", r"Sr\.", "Sir", "Господин", "Κύριος"],
    "f": [r"Mrs\.?", r"mrs\.", r"MRS\.?", r"Ms\.?", r"ms\.", r"MS\.", "Miss", "Frau", "FRAU", "Madame", r"Mme\.?", "Mademoiselle", r"Mlle\.?", "Señora", "Señorita", r"Sra\.", "Госпожа", "Κυρία"],
    "n": [r"Dr\.?", r"dr\.", r"DR\.", r"Prof\.?", r"prof\.", r"PROF\."],
}
PARTICLES = "van von der den de del della di da du la le zu zur ter ten el al bin ibn af av".split()
NO_NAMES = (
    "a an the and or but if so as at by for from in into of off on onto out over to up with after before while when where why how what which that this these those there here then than not no yes "
    "he she it its his her him they them their we us our you your i me my is are was were be been has have had do does did done will would shall should can could may might must "
    "goes go went gone comes came says said gets got makes made takes took sees saw knows thinks asks asked told tells gives gave "
    "der die das den dem des ein eine einen und oder aber wenn als am im ist war sind hat hatte wird er sie es wir ihr ich du nach vor bei mit von zu auf aus sprach ging kam sagte "
    "le les un une des et ou mais si est était sont a il elle ils elles nous vous je en dans pour sur avec "
    "los las el una unos y o pero es era son fue ella ellos nosotros yo por para con del al monday tuesday wednesday thursday friday saturday sunday"
).split()
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Frida", "Greta", "Hanna", "Irma", "Julia", "Karin", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sascha", "Noa", "Jules", "Sam", "Charlie", "Andrea", "Dominique", "Eden", "Quinn"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "n"): ["Φώτης", "Αγγελική"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "da", "den", "fal", "gar", "hol", "ka", "kel", "lan", "lor", "ma", "mir", "nor", "pel", "ra", "ros", "sel", "tam", "tor", "va", "ver", "wen"],
    "cyrillic": ["ба", "вер", "гор", "дал", "зим", "кор", "лен", "мир", "нов", "пет", "рос", "сав", "тар", "фед"],
    "greek": ["βα", "γερ", "δελ", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαρ", "τσα", "φιλ"],
}
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L}))(?=\p{L})){1,40}+"
_TITLE = "(?:" + "|".join(t for x in TITLES.values() for t in x) + ")"
_GAP = r"[\s\u00A0]{1,3}"
#: Titles in a row, and the gap behind each.
_LEAD = rf"(?:{_TITLE}{_GAP})+"
_PARTICLE = f"(?:{'|'.join(PARTICLES)})"
#: A name that is none of NO_NAMES, in capitals or not.
_BEARER = rf"(?!(?i:{'|'.join(sorted(set(NO_NAMES)))})(?![\p{{L}}'’-])){_NAME}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}][\p{L}\p{N}-]{0,62}\.){1,8}\p{L}{2,24}",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # The last three: three, three and four digits with blanks, or without where area and exchange may be dialled; a trunk zero with an area, and a number.
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\d+][ -]?)[2-9]\d\d [2-9]\d\d \d{4}(?![ -]?\d)|(?<![\d+][ .-]?)[2-9]\d\d[2-9]\d{6}(?![ .-]?\d)|(?<![\d+][ -]?)0[1-9]\d{1,3}[ /]\d{6,8}(?![ -]?\d)",
    "secret": r"(?<=[=:\"']|[=:] |[=:]  )(?<=(?i:token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[\p{L}\p{N}+/_-]{8,}+|(?<![\p{L}\p{N}])AKIA[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "person": rf"(?=[MmHFSDdPpГΚ])(?<![\p{{L}}\p{{N}}]){_LEAD}(?:\p{{Lu}}\. ?|{_PARTICLE} ){{0,3}}{_BEARER}(?: (?:\p{{Lu}}\. )?(?:{_PARTICLE} ){{0,2}}{_BEARER}){{0,2}}",
}
_OTHERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ipv4", "ssn", "phone"))
_CARD = r"(?<![\d+])(?:\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4}-\d{6}-\d{5}|\d{4} \d{6} \d{5})(?!\d)"
# Other groupings of a card end where a number of another kind begins, whether or not the check digit is right.
PATTERNS["card"] = rf"{_CARD[:-6]}(?:[ -]\d{{3}})?(?!\d)|(?<![\d+])(?:\d(?:[ -](?!{_OTHERS}|{_CARD}))?){{12,18}}\d(?!\d)"
# What begins with a digit, a plus or a bracket is looked for only there.
_NUMBERS = rf"{_OTHERS}|(?:{PATTERNS['card']})"
# A secret may begin with digits that look like a card.
PATTERN = f"{PATTERNS['email']}|(?:{PATTERNS['secret']})|(?=[0-9+(])(?:{_NUMBERS})|{PATTERNS['person']}"
#: The same, or any word that may be a name.
WITH_NAMES = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){_NAME}"
#: What may stand before an address and is no part of it.
MARKS = r"^[._%+-]+"
#: What every entity has somewhere; texts without it need no search.
CUE = rf"[0-9@=:]|(?=[MmHFSDdPpГΚ])(?<![\p{{L}}\p{{N}}]){_TITLE}[\s\u00A0]"

#: Forms whose surrogates one task draws.
DRAWN = 500


def _at(s: Column, i: Column, n: int = 1) -> Column:
    return F.substring(s, i, F.lit(n))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10; a last digit that is missing counts 0 if `digits` ends in 0."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _doubled(_at(digits, n - i + 1).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def _card(digits: Column) -> Column:
    """The card among a stretch's digits: all, or of 18 and 19 the first but three, if only theirs is the right check digit."""
    short = F.substring(digits, F.lit(1), F.length(digits) - 3)
    return F.when((F.length(digits) < 18) | (_luhn(digits) == 0) | (_luhn(short) != 0), digits).otherwise(short)


def _kind(v: Column) -> Column:
    whole = lambda p: v.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(v, r"\D", "")
    card = whole(r"(?:\d[ -]?){12,18}\d")
    k = F.when(whole(PATTERNS["email"]), "email").when(whole(PATTERNS["ipv4"]), "ipv4")
    k = k.when(card & (_luhn(F.when(card, _card(digits)).otherwise("0")) == 0), "card").when(card & ~v.rlike(r"[ -]"), F.lit(None).cast("string"))
    return k.when(whole(PATTERNS["ssn"]), "ssn").when(whole(PATTERNS["phone"]), "phone").when(card, F.lit(None).cast("string")).when(whole(PATTERNS["person"]), "person").otherwise("secret")


def _script(word: Column) -> Column:
    out = F.when(word.rlike("^" + SCRIPTS["latin"]), "latin")
    return out.when(word.rlike("^" + SCRIPTS["cyrillic"]), "cyrillic").when(word.rlike("^" + SCRIPTS["greek"]), "greek").otherwise("latin")


def _titled(gender: str) -> str:
    return rf"(?<![\p{{L}}])(?:{'|'.join(TITLES[gender])})[\s\u00A0]"


def _parts(v: Column, kind: Column) -> Column:
    """What of an entity gets surrogates of its own: (kind, canonical form, as written). A name's words do, one by one."""
    one = F.lower(F.regexp_replace(v, MARKS, ""))
    canon = F.when(kind == "card", _card(F.when(kind == "card", F.regexp_replace(v, r"\D", "")).otherwise("0"))).when(kind == "ssn", F.regexp_replace(v, r"\D", "")).when(kind == "phone", F.regexp_replace(F.regexp_replace(v, r"[^\d+]", ""), r"^\+1(?=\d{10}$)", "")).when(kind.isin("email"), one).otherwise(v)
    lead = F.regexp_extract(v, f"^({_LEAD})", 1)
    gender = F.when(lead.rlike(_titled("f")), "f").when(lead.rlike(_titled("m")), "m").otherwise("n")
    # Titles, gaps, particles and initials stay as they are.
    words = F.concat(F.array(lead), F.regexp_extract_all(F.substring(v, F.length(lead) + 1, F.length(v)), F.lit(r"\p{Lu}\.|[\s\u00A0]+|[^\s\u00A0]+"), F.lit(0)))
    last = F.size(words) - 1

    def word(w: Column, i: Column) -> Column:
        fixed = (i == 0) | w.rlike(rf"^(?:\p{{Lu}}\.|[\s\u00A0]+|{_PARTICLE})$")
        k = F.when(fixed, "as is").when(i == last, F.concat_ws(":", F.lit("surname"), _script(w))).otherwise(F.concat_ws(":", F.lit("given"), _script(w), gender))
        return F.struct(k.alias("kind"), F.lower(w).alias("canon"), w.alias("written"))

    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), v.alias("written"))))


def _number(digest: Column, i: Column) -> Column:
    """Two hex digits of a digest, from place i (0, 1, ...) on, round about."""
    return F.conv(_at(digest, (i % 64) * 2 + 1, 2), 16, 10).cast("int")


def _likewise(canon: Column, digest: Column) -> Column:
    """Every digit and letter replaced by one of its sort. Later stretches of a long form use digests of their own."""

    def one(c: Column, i: Column) -> Column:
        n = _number(F.sha2(F.concat_ws("|", digest, F.floor(i / 64).cast("string")).cast("binary"), 512), i)
        out = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
        for s, letters in ALPHABETS.items():
            pick = _at(F.lit(letters), n % len(letters) + 1)
            out = out.when(F.lower(c).rlike("^" + SCRIPTS[s]), F.when(F.lower(c) == c, pick).otherwise(F.upper(pick)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _picked(names: list[str], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), _number(digest, F.lit(i)) % len(names) + 1)


def _syllables(script: str, names: int, count: int) -> int:
    """Invented syllables that `names` others need beside them, so that there are eight names for each of `count`."""
    n = 0
    while names * len(SYLLABLES[script]) ** n < 8 * count:
        n += 1
    return n


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str, counts: dict[str, int]) -> Column:
    """counts: how many forms there are of each kind."""
    d = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    like = _likewise(canon, d)
    n = F.length(canon)
    # After some attempts addresses get more letters, and after more numbers more digits.
    letters = F.when(attempt >= 3, F.substring(d, F.lit(100), F.least(attempt - 2, F.lit(28)))).otherwise("")
    more = F.when(attempt >= 12, F.translate(F.substring(d, F.lit(100), F.least(attempt - 11, F.lit(28))), "abcdef", "012345")).otherwise("")
    # Addresses keep the top domain, phones their country code, with an area code that may be dialled.
    top, at = F.regexp_extract(canon, r"\.([^.]+)$", 1), F.locate("@", canon)
    email = F.concat(F.substring(like, F.lit(1), at - 1), letters, F.substring(like, at, n - F.length(top) - at + 1), top)
    code = F.when(canon.rlike("^0"), 1).when(canon.rlike(r"^\+7"), 2).when(canon.rlike(r"^\+"), 3).otherwise(0)
    phone = F.concat(F.substring(canon, F.lit(1), code), (_number(d, F.lit(63)) % 8 + 2).cast("string"), F.substring(like, code + 2, n), more)
    ip = F.concat_ws(".", (_number(d, F.lit(0)) % 223 + 1).cast("string"), *[_number(d, F.lit(k)).cast("string") for k in (1, 2)], (_number(d, F.lit(3)) % 254 + 1).cast("string"))
    ip = F.concat(ip, F.when(more == "", "").otherwise(F.concat(F.lit(":"), more)))
    body = F.concat(F.substring(canon, 1, 1), F.substring(like, F.lit(2), n - 2), more)
    card = F.concat(body, ((10 - _luhn(F.concat(F.when(kind == "card", body).otherwise("0"), F.lit("0")))) % 10).cast("string"))
    ssn = F.concat((_number(d, F.lit(62)) % 5 + 1).cast("string"), F.substring(like, 2, 8), more)
    hexes = F.substring(F.repeat(d, F.ceil(n / 128).cast("int")), F.lit(1), n)
    key_like = F.when(canon.rlike("^AKIA[A-Z0-9]{16}$"), F.concat(F.lit("AKIA"), F.substring(like, 5, 16))).when(canon.rlike("^[0-9a-f]+$"), hexes).when(canon.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(like)
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ipv4", ip).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "secret", F.concat(key_like, more))
    later = F.floor(attempt / 3).cast("int")

    def invented(script: str, first: int, n: Column) -> Column:
        some = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first - 1) + n), lambda i: F.element_at(some, _number(d, i) % len(SYLLABLES[script]) + 1)), "")

    for (s, g), names in GIVEN.items():
        # One listed name, two or three, and where these are too few, two and syllables.
        count, some = counts.get(f"given:{s}:{g}", 0), len(names)
        room = F.lit(-2 if 2 * count <= some else -1 if 8 * count <= some**2 else 0 if 8 * count <= some**3 else _syllables(s, some**2, count)) + later
        one, two, three = (_picked(names, d, k) for k in (0, 1, 2))
        added = F.initcap(invented(s, 3, F.greatest(F.lit(1), room)))
        out = out.when(kind == f"given:{s}:{g}", F.when(room <= -2, one).when(room == -1, F.concat_ws("-", one, two)).when(room == 0, F.concat_ws("-", one, two, three)).otherwise(F.concat_ws("-", one, two, added)))
    for s in SYLLABLES:
        out = out.when(kind == f"surname:{s}", F.initcap(invented(s, 0, F.lit(max(3, _syllables(s, 1, counts.get(f"surname:{s}", 0)))) + later)))
    return F.when(kind == "as is", canon).otherwise(out)


def _rendered(kind: Column, written: Column, surrogate: Column) -> Column:
    """The surrogate in the form that the entity was written in. A country code that the canonical form lacks stays."""
    marks = F.split(written, "")
    new = F.regexp_replace(surrogate, r"\D", "")
    had = F.length(F.regexp_replace(written, r"\D", ""))
    lead = F.when(kind == "phone", F.greatest(had - F.length(new), F.lit(0))).otherwise(0)
    nth = lambda i: F.length(F.regexp_replace(F.substring(written, F.lit(1), i + 1), r"\D", "")) - lead
    digits = F.transform(marks, lambda c, i: F.when(c.rlike("[0-9]") & nth(i).between(1, F.length(new)), _at(new, nth(i))).otherwise(c))
    numbers = F.concat(F.array_join(digits, ""), F.substring(new, had - lead + 1, F.length(new)))
    cased = F.zip_with(F.split(F.regexp_replace(written, MARKS, ""), ""), F.split(surrogate, ""), lambda c, s: F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(s)).otherwise(F.coalesce(s, F.lit(""))))
    cased = F.when(F.upper(written) == written, F.upper(surrogate)).otherwise(F.array_join(cased, ""))
    name = F.when((F.upper(written) == written) & (F.length(written) > 1), F.upper(surrogate)).otherwise(surrogate)
    out = F.when(kind.isin("card", "ssn", "phone"), numbers).when(kind == "email", F.concat(F.regexp_extract(written, MARKS, 0), cased))
    return out.when(kind.isin("ipv4", "secret"), surrogate).when(kind == "as is", written).otherwise(name)


def surrogates(forms: DataFrame, key: str) -> DataFrame:
    """forms(kind, canon), distinct -> with surrogate, distinct within a kind and never a form of the table."""
    forms = staged(forms.where("kind <> 'as is'"), "pii-forms")
    counts = {r.kind: r["count"] for r in forms.groupBy("kind").count().collect()}  # a row per kind
    pending, done, left, attempt = forms, [], sum(counts.values()), 0
    while left:
        # A small table is one split; drawing is work for more tasks.
        tasks = max(1, min(left // DRAWN, 4 * int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        tried = pending.repartition(tasks, "kind", "canon").withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key, counts))
        first = F.row_number().over(W.partitionBy("kind", F.lower("surrogate")).orderBy(F.sha2(F.concat_ws("|", F.lit(key), "canon").cast("binary"), 256), "canon"))
        tried = tried.withColumn("place", first).withColumn("low", F.lower("surrogate"))
        taken = reduce(DataFrame.union, [forms.select("kind", F.lower("canon").alias("low")), *[d.select("kind", F.lower("surrogate").alias("low")) for d in done]]).distinct().withColumn("taken", F.lit(True))
        tried = staged(tried.join(taken, ["kind", "low"], "left").select("kind", "canon", "surrogate", (F.col("taken").isNull() & (F.col("place") == 1)).alias("ok")), "pii-tried")
        done.append(tried.where("ok").select("kind", "canon", "surrogate"))
        pending = tried.where("not ok").select("kind", "canon")
        left, attempt = pending.count(), attempt + 1
    return reduce(DataFrame.union, done) if done else forms.withColumn("surrogate", F.col("canon"))


def pseudonymise(docs: DataFrame, key: str = "zonehour", text_col: str = "text") -> DataFrame:
    """docs with the entities of text_col replaced, and n_entities; a column of that name gives way.

    Equal entities get equal surrogates in all rows, unlike ones unlike
    surrogates, and the same key gives the same result for the same table. A null
    text stays null with 0 entities; texts without entities stay as they are.
    Numbers that only look like a card (wrong check digit) are no entity, nor is
    a secret of 13 to 19 digits and nothing else that is none; what is
    written like a phone, an address or a social security number is that, and
    never a part of a card. A phone number is the same with and without the
    country code +1. Where a name with a form of address is found, its words are
    replaced in the whole document, in capitals too; titles, initials and particles stay. A name that never has one is not found, nor
    are IPv6 addresses, bank accounts and dates of birth. Very long texts are
    searched whole.
    Repeated rows are rows of the result each, an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != "n_entities"]
    text = F.col(text_col)
    cued = F.coalesce(text.rlike(CUE), F.lit(False))
    docs = docs.select(*kept)
    digest = F.sha2(text.cast("binary"), 256)
    found = docs.where(cued).select(digest.alias("td"), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("found"))
    # Copies of a text are looked at once.
    found = staged(found.where(F.size("found") > 0).dropDuplicates(["td"]), "pii-found").select("td", F.explode("found").alias("value"))
    values = found.select("value").distinct().select("value", _kind(F.col("value")).alias("kind")).where("kind is not null")
    parts = staged(values.select("value", F.posexplode(_parts(F.col("value"), F.col("kind"))).alias("place", "part")).select("value", "place", "part.*"), "pii-parts")
    chosen = surrogates(parts.select("kind", "canon").distinct(), key)
    new = staged(parts.join(chosen, ["kind", "canon"], "left").select("value", "place", "kind", "written", _rendered(F.col("kind"), F.col("written"), F.col("surrogate")).alias("new")), "pii-new")
    written = new.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]), "").alias("new"))
    # A document's entities, and the single words of its names, in capitals or not; where a word is two names, a surname's surrogate stands.
    forms = lambda c: F.array(c, F.upper(c), F.initcap(c))
    names = new.where(F.col("kind").startswith("given") | F.col("kind").startswith("surname")).select("value", "kind", F.explode(F.arrays_zip(forms(F.col("written")).alias("word"), forms(F.col("new")).alias("new"))).alias("f")).where(F.length("f.word") > 1)
    names = names.select("value", "f.word", F.struct(F.when(F.col("kind").startswith("surname"), 1).otherwise(2).alias("rank"), F.col("f.new").alias("new")).alias("to"))
    # As tables, so that a value of very many documents may be split where they meet.
    written, names = staged(written, "pii-written"), staged(names, "pii-names")
    each = found.join(written, "value").select("td", "value", F.struct(F.lit(0).alias("rank"), "new").alias("to")).union(found.join(names, "value").select("td", F.col("word").alias("value"), "to"))
    each = each.groupBy("td", "value").agg(F.min("to").alias("to"))
    maps = each.groupBy(F.col("td").alias("__td")).agg(F.map_from_entries(F.collect_list(F.struct("value", "to.new"))).alias("__news"), F.max(F.col("to.rank") > 0).alias("__named"))
    many = docs.where(cued).withColumn("__d", digest).join(maps, F.col("__d") == F.col("__td"), "left")
    # Searched once: a column of its own is not worked out again where it is used.
    many = many.withColumn("__hits", F.when(F.col("__named"), F.regexp_extract_all(text, F.lit(WITH_NAMES), F.lit(0))).when(F.col("__news").isNotNull(), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    hits = F.col("__hits")
    new = F.transform(hits, lambda e: F.coalesce(F.try_element_at(F.col("__news"), e), e))
    gaps = F.when(F.col("__named"), F.split(text, WITH_NAMES, -1)).otherwise(F.split(text, PATTERN, -1))
    whole = F.array_join(F.zip_with(gaps, new, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")
    count = F.size(F.filter(hits, lambda e: F.try_element_at(F.col("__news"), e).isNotNull()))
    changed = many.select(*[F.when(F.col("__news").isNull(), text).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in kept], F.when(F.col("__news").isNull(), 0).otherwise(count).cast("int").alias("n_entities"))
    return changed.union(docs.where(~cued).withColumn("n_entities", F.lit(0)))
