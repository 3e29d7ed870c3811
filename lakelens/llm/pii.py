"""Operator 2: PII surrogates. All of it runs on DataFrame functions in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh_names, stash

#: Titles, as they are written at the start of a sentence (fixed values).
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Signora", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Signor", "Господин", "Κύριος")


def _titles(words: tuple[str, ...]) -> str:
    """An expression for titles in any case; "miss" is also a word, so it counts only with a capital. The class of first
    letters comes first, as it rules out most places of a text at once."""
    forms = sorted({f for w in words for f in (w, w.upper(), w.lower()) if f != "miss"}, key=lambda f: (-len(f), f))
    return rf"(?=[{''.join(sorted({f[0] for f in forms}))}])(?<![\p{{L}}\p{{M}}])(?:{'|'.join(forms)})"


FEMALE_TITLE = rf"{_titles(FEMALE)}\.? "
TITLE = rf"{_titles(FEMALE + MALE)}\.? "
#: A capitalised word, with its apostrophes and hyphens but not an English 's. Possessive, as is all that repeats without a
#: bound: such loops don't recurse.
WORD = r"\p{Lu}['’]?+(?:[\p{L}\p{M}]++(?:(?!['’][sS](?![\p{L}\p{M}]))['’-](?=\p{L}))?+)++"
#: What is found, in order of precedence. A mailbox has at most 64 characters, a host at most 127 labels of at most 63.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]{0,63}@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,126}\p{L}[\p{L}\p{M}]{1,62}",
    "key": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"{TITLE}{WORD}(?: {WORD})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Where a text has a titled name, its other capitalised words are looked at too: some may be that name without its title.
NAMED = rf"{TITLE}\p{{Lu}}"
WITH_WORDS = rf"{ENTITY}|(?<![\p{{L}}\p{{M}}\p{{N}}]){WORD}"
#: A text without any of these has no entity.
HINT = rf"[0-9@]|{TITLE}\p{{Lu}}"
ATTEMPTS = 40

#: Scripts in which vowels and consonants stay what they are: (name in Unicode, first and last code points of its letters,
#: vowels, what surrogates' vowels and consonants are). Fixed values.
ALPHABETS = (
    ("LATIN", ((0x41, 0x24F), (0x1E00, 0x1EFF)), "aeiouyæøœı", "aeiou", "bcdfghjklmnpqrstvwxz"),
    ("CYRILLIC", ((0x400, 0x52F),), "аеиоуыэюяєі", "аеиоуя", "бвгдзклмнпрстфхшж"),
    ("GREEK", ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "αεηιουω", "αεηιου", "βγδζθκλμνξπρστφχ"),
)
#: Other scripts: a regular expression's name for each, and code points of letters that stand for its letters. Fixed values.
OTHERS = {"Han": range(0x4E00, 0x9F00, 151), "Hiragana": range(0x3042, 0x3094), "Katakana": range(0x30A2, 0x30F4), "Hangul": range(0xAC00, 0xD7A0, 140), "Arabic": range(0x627, 0x64B), "Hebrew": range(0x5D0, 0x5EB), "Devanagari": range(0x915, 0x93A), "Thai": range(0xE01, 0xE2F), "Armenian": range(0x561, 0x587), "Georgian": range(0x10D0, 0x10F1)}


def _classes() -> tuple[str, str, dict[str, str]]:
    """(letters and digits, the mark of each one's class, the characters that a class's surrogates are drawn from). Marks are
    of the private use area, so none is a letter."""
    letters, marks, pools = "0123456789", "" * 10, {"": "0123456789"}
    for k, (name, ranges, vowels, a, b) in enumerate(ALPHABETS):
        for upper in (0, 1):
            for vowel, pool in enumerate((b, a)):
                pools[chr(0xE001 + 4 * k + 2 * upper + vowel)] = pool.upper() if upper else pool
        for cp in (c for lo, hi in ranges for c in range(lo, hi + 1)):
            ch = chr(cp)
            if unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith(name):
                base = unicodedata.normalize("NFD", ch)[0].lower()
                letters += ch
                marks += chr(0xE001 + 4 * k + 2 * ch.isupper() + (base in vowels))
    return letters, marks, pools


_LETTERS, _MARKS, _POOLS = _classes()
_OTHERS = {k: "".join(chr(c) for c in r if unicodedata.category(chr(c)) in ("Lo", "Ll")) for k, r in OTHERS.items()}


def kind(entity: Column) -> Column:
    """The first pattern that the whole entity fits; word for a capitalised word that may be a name."""
    return reduce(lambda c, k: c.when(entity.rlike(rf"^(?:{PATTERNS[k]})$"), k), PATTERNS, F).otherwise("word")


def parts(entity: Column, type_: Column) -> Column:
    """Array of (lead, form, type, norm, role): an entity in its pieces, each as it is written, after what stands before it,
    and as what co-refers has it. A name has a piece for each word; with two, the first is a given name of the title's gender."""
    part = lambda lead, form, t, norm, role: F.struct(lead.alias("lead"), form.alias("form"), t.alias("type"), norm.alias("norm"), role.alias("role"))
    title = F.regexp_extract(entity, f"^{TITLE}", 0)
    words = F.split(F.substr(entity, F.length(title) + 1), " ")
    gender = F.when(entity.rlike(f"^{FEMALE_TITLE}"), "female").otherwise("male")
    none = F.lit(None).cast("string")
    low = lambda c: F.replace(F.lower(c), F.lit("i\u0307"), F.lit("i"))  # a dotted capital I becomes one letter
    named = F.transform(words, lambda w, i: part(F.when(i == 0, title).otherwise(" "), w, F.lit("name"), low(w), F.when((i == 0) & (F.size(words) > 1), gender)))
    norm = F.when(type_.isin("phone", "ssn", "card"), F.regexp_replace(entity, r"\D", "")).when(type_ == "iban", F.regexp_replace(entity, " ", "")).otherwise(low(entity))
    return F.when(type_ == "name", named).otherwise(F.array(part(F.lit(""), entity, type_, norm, none)))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, not at each place where use has it."""
    return F.transform(F.array(value), use)[0]


def _letters(text: Column, stream: Column) -> Column:
    """Each letter or digit of text becomes another of its script and kind by the stream (hexadecimal, two places to a
    character), never itself; a letter of a script without a table becomes a Latin one. The rest stays."""

    tables = F.expr(f"map({', '.join(f"'{m}', '{p}'" for m, p in _POOLS.items())})")

    def draw(z: Column, i: Column, stream: Column) -> Column:
        pool = F.when(tables[z["m"]].isNotNull(), tables[z["m"]])
        for script, p in _OTHERS.items():
            pool = pool.when(z["c"].rlike(rf"[\p{{L}}&&\p{{Is{script}}}]"), p)
        pool = pool.when(z["c"].rlike(r"\p{L}"), ALPHABETS[0][4])
        return F.struct(z["c"].alias("c"), pool.alias("pool"), F.conv(F.substring(stream, (2 * i) % 126 + 1, 2), 16, 10).cast("int").alias("v"))

    def pick(d: Column) -> Column:
        at = lambda k: F.substring(d["pool"], k % F.length(d["pool"]) + 1, F.lit(1))
        return F.coalesce(F.when(at(d["v"]) != d["c"], at(d["v"])).otherwise(at(d["v"] + 1)), d["c"])

    def every(s: Column) -> Column:
        zipped = F.arrays_zip(_chars(s["t"]).alias("c"), _chars(F.translate(s["t"], _LETTERS, _MARKS)).alias("m"))
        return F.array_join(F.transform(F.transform(zipped, lambda z, i: draw(z, i, s["x"])), pick), "")

    return _let(F.struct(text.alias("t"), stream.alias("x")), every)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number modulo 10."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits: 98 less the number that account, country and 00 spell, letters counting from 10, modulo 97."""
    left = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - left).cast("string"), 2, "0")


def surrogates(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """Adds surrogate to (type, norm, gender); the same for the same key and attempt."""
    type_, norm, gender, stream, drawn = map(F.col, ("type", "norm", "gender", "stream", "drawn"))
    seed = F.concat_ws("\u0001", F.lit(key), type_, norm, F.lit(str(attempt)))
    n, more = F.length(norm), F.lit(attempt // 4)  # short forms grow if all are taken
    code = F.when((type_ == "phone") & (n > 10), n - 10).otherwise(0)  # the country's
    at, dot = F.instr(norm, "@"), F.length(F.substring_index(norm, ".", -1))
    local = F.substring(norm, F.lit(1), at - 1)
    raw = F.when(type_.isin("phone", "ssn", "card"), F.substring(norm, code + 1, n)).when(type_ == "iban", F.substring(norm, F.lit(5), n))
    raw = raw.when(type_ == "email", F.concat(local, F.substring(local, F.lit(1), more), F.substring(norm, at, n - at - dot + 1))).when(type_ == "name", F.concat(norm, F.substring(norm, F.lit(1), more))).otherwise("")
    base = entities.withColumn("stream", F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))).withColumn("drawn", _letters(raw, stream))

    numbers = F.concat(F.substring(norm, F.lit(1), code), drawn)
    body = F.substring(drawn, F.lit(1), n - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    octet = lambda k: F.conv(F.substring(stream, F.lit(2 * k + 1), F.lit(2)), 16, 10)
    address = lambda head, first: F.concat_ws(".", head, *map(octet, range(first, 4)))
    public = 11 + octet(0).cast("int") % 115  # neither private, nor loopback, nor reserved
    inner = r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\."
    ip = F.when(norm.rlike(r"^(?:10|127)\."), address(F.substring_index(norm, ".", 1), 1))
    if attempt < 20:
        ip = ip.when(norm.rlike(r"^172\.") & norm.rlike(inner), address(F.concat(F.lit("172."), (16 + octet(1).cast("int") % 16).cast("string")), 2)).when(norm.rlike(inner), address(F.substring_index(norm, ".", 2), 2))
    ip = ip.when(norm.rlike(inner), address(F.lit("10"), 1))  # their own range is full
    ip = ip.otherwise(address(F.when(public == 100, 101).otherwise(public).cast("string"), 1))
    country = F.substring(norm, F.lit(1), F.lit(2))
    ends = reduce(lambda c, x: c.when(norm.rlike(rf"\p{{Is{x[0]}}}"), F.when(gender == "female", x[1]).when(gender == "male", x[2])), (("Latin", "a", "n"), ("Cyrillic", "а", "н"), ("Greek", "α", "ν")), F)
    out = (
        F.when(type_ == "key", F.substring(stream, F.lit(1), n))
        .when(type_ == "ip", ip)
        .when(type_ == "iban", F.concat(country, _iban_check(country, drawn), drawn))
        .when((type_ == "card") & (_luhn(norm) == 0), checked)
        .when(type_.isin("card", "phone", "ssn"), numbers)
        .when(type_ == "email", F.concat(drawn, F.substring_index(norm, ".", -1)))
        .otherwise(F.when(ends.isNotNull(), F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), ends)).otherwise(drawn))
    )
    return base.withColumn("surrogate", out).select("type", "norm", "gender", "surrogate")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate) of the distinct (type, norm, gender). No two of a type share a surrogate and none is an
    original of its type: those that clash, but for the smallest norm, try again. The driver sees only whether any are left."""
    left, taken = entities, None
    for attempt in range(ATTEMPTS):
        new = surrogates(left, attempt, key)
        free = new.join(entities.select("type", F.col("norm").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = stash(free.groupBy("type", "surrogate").agg(F.min("norm").alias("norm")).select("type", "norm", "surrogate"), "pii-surrogates")
        taken = won if taken is None else taken.union(won)
        left = stash(left.join(won.select("type", "norm"), ["type", "norm"], "left_anti"), "pii-left")
        if left.isEmpty():
            return taken
    raise RuntimeError("no distinct surrogates are left for some format")


def _surface(form: Column, type_: Column, sur: Column) -> Column:
    """The surrogate in the form of the original: its separators and its case."""
    acc = lambda s, i: F.struct(s.alias("s"), i.alias("i"))
    dealt = F.aggregate(_chars(form), acc(F.lit(""), F.lit(1)), lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), acc(F.concat(a["s"], F.substring(sur, a["i"], F.lit(1))), a["i"] + 1)).otherwise(acc(F.concat(a["s"], c), a["i"])), lambda a: a["s"])
    both = F.arrays_zip(_chars(sur).alias("s"), _chars(form).alias("f"))
    cased = F.array_join(F.transform(both, lambda b: F.when(b["f"].rlike(r"\p{Lu}"), F.upper(b["s"])).otherwise(F.coalesce(b["s"], F.lit("")))), "")
    whole = F.when((form == F.upper(form)) & (form != F.lower(form)), F.upper(sur)).when(type_ == "name", cased).otherwise(sur)
    return F.when(type_.isin("phone", "ssn", "card", "iban"), dealt).otherwise(whole)


def replace_pii(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with each detected entity of its text replaced by its surrogate, and n_entities.

    The same entity gets the same surrogate everywhere, in the format of each occurrence. A word of a name has one surrogate,
    whatever its place; it has a gender where two-word names use it as a given name, by most of them. In a text with a titled
    name its words are replaced without a title too, if capitalised. A null text stays null and has no entities; texts
    without entities stay as they are and aren't shuffled. Repeated rows are replaced alike, each distinct text once. A
    column n_entities of df is replaced, others keep their names and values. An empty table gives an empty result.

    All rows of the intermediate tables are pieces of texts, so the work is in proportion to the texts' lengths. What is
    joined is broadcast only below Spark's own size limit."""
    base = df.drop("n_entities")
    sha, found, between, new, count = fresh_names(base, 5)
    has = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(ENTITY), F.lit(False))
    none = base.filter(~has).withColumn("n_entities", F.lit(0))
    t, named = F.col(text), F.col(text).rlike(NAMED)
    cut = lambda f: F.when(named, f(F.lit(WITH_WORDS))).otherwise(f(F.lit(ENTITY)))
    some = base.filter(has).select("*", F.sha2(t, 256).alias(sha), cut(lambda p: F.regexp_extract_all(t, p, 0)).alias(found), cut(lambda p: F.split(t, F.get(F.array(p), 0), -1)).alias(between))
    some = stash(some.drop(text), "pii-rows")
    texts = some.select(F.col(sha).alias("sha"), F.col(found).alias("found"), F.col(between).alias("between")).dropDuplicates(["sha"])
    each = texts.select("sha", F.posexplode("found").alias("pos", "entity")).withColumn("kind", kind(F.col("entity")))
    each = stash(each.select("sha", "pos", F.posexplode(parts(F.col("entity"), F.col("kind"))).alias("k", "part")).select("sha", "pos", "k", "part.*"), "pii-pieces")
    # words that aren't part of a titled name of their text stay
    own = each.filter("type = 'name'").select("sha", "norm", F.lit(True).alias("own")).distinct()
    words = each.filter("type = 'word'").join(own, ["sha", "norm"], "left")
    stay = words.filter("own is null").select("sha", "pos", "k", F.col("form").alias("s"), F.lit(0).alias("one"))
    due = each.filter("type <> 'word'").unionByName(words.filter("own").drop("own").withColumn("type", F.lit("name")))
    gender = F.when(F.count(F.when(F.col("role") == "female", 1)) > F.count(F.when(F.col("role") == "male", 1)), "female").when(F.count("role") > 0, "male")
    known = assign(stash(due.groupBy("type", "norm").agg(gender.alias("gender")), "pii-distinct"), key)
    shown = due.join(known, ["type", "norm"]).select("sha", "pos", "k", F.concat("lead", _surface(F.col("form"), F.col("type"), F.col("surrogate"))).alias("s"), (F.col("k") == 0).cast("int").alias("one"))
    got = shown.unionByName(stay).groupBy("sha").agg(F.collect_list(F.struct("pos", "k", "s")).alias("got"), F.sum("one").cast("int").alias("n"))
    leads = F.transform("between", lambda b, i: F.struct(i.cast("int").alias("pos"), F.lit(-1).alias("k"), b.alias("s")))
    done = texts.select("sha", leads.alias("leads")).join(got, "sha").select(F.col("sha").alias(sha), F.array_join(F.transform(F.array_sort(F.concat("leads", "got")), lambda p: p["s"]), "").alias(new), F.col("n").alias(count))
    out = some.join(done, sha).withColumnsRenamed({new: text, count: "n_entities"}).select(none.columns)
    return none.unionByName(out)
