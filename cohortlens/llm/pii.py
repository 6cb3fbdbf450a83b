"""Personal data and secrets replaced by keyed surrogates, in DataFrame functions only.

Entities: e-mail addresses, phone numbers, IP addresses of both versions, payment cards, social
security numbers, access keys, hexadecimal secrets, and names after a title with their bare mentions
in the same text.  An undivided run of digits is a card only if its check digit holds,
hexadecimal signs are a secret only with digits and letters.  An entity's canonical form (lower case, digits alone (after the country
code), the words of a name) gets a surrogate from a keyed digest, of the same type and format: digits
for digits, card check digits that hold (or fail) as before, first names by the title's gender and in the script of the
original.  Collisions are checked over all entities of the
corpus: a surrogate that two entities would share, or that is a real entity, is drawn again for all
but the least of them; names and e-mails grow longer where short ones run out, and digits that have no
free surrogate left are exchanged among themselves.  So distinct entities stay distinct, and equal
ones stay equal in every text.

Texts are searched once and written with what was found; only distinct entities are shuffled after
that, and texts that hold some.  The key comes from the caller (:func:`session_key`).

Defined results: a null or empty text stays as it is; texts without entities are unchanged; repeated
rows stay, and get equal texts; an empty table gives an empty one; patterns are bounded, so that very
long texts take time in proportion; all columns are kept as they are, whatever their names, but the
text (and the count, if one is named).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import Tables, documents, free_name, save

#: Titles by gender, syllables of made names by script, and endings by gender.
TITLES_M = ("Mr", "Mister", "Herr", "Señor", "Sr", "Don", "don", "Monsieur", "Signor", "господин", "Господин", "пан", "Пан", "Sir")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Doña", "doña", "Madame", "Mme", "Mlle", "Signora", "госпожа", "Госпожа", "пани", "Пани", "пані", "Пані", "Lady")
#: Titles that tell no gender.
TITLES_N = ("Dr", "Doctor", "Doktor", "Prof", "Professor", "доктор", "Доктор", "профессор", "Профессор")
_TITLES = "|".join(sorted((*TITLES_M, *TITLES_F, *TITLES_N), key=len, reverse=True))
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "se", "ta", "te", "va"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "га", "го", "да", "де", "до", "за", "зо", "ка", "ке", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "ра", "ре", "ро", "са", "се", "та", "те", "то"),
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("latin", "n"): "l", ("latin", "l"): "rd", ("cyrillic", "n"): "ль", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "l"): "нко"}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:-\p{Lu}\p{L}++){0,4}"
#: Words and what stands between them; a name with a hyphen or O' is one word.
_TOKENS = r"(?s)(?:\p{Lu}['’](?=\p{Lu}))?\p{L}++(?:-\p{Lu}\p{L}++){0,4}|\P{L}++"
_PHONES = (
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)",
    r"\+\d(?:[ .()/-]{0,2}\d){7,14}(?!\d)",
    r"\+\d{1,3}(?:[.-]\d{2,4}){2,4}(?!\d)",
    r"(?<![\d+])\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)",
    *(rf"(?<![\w+-])(?<!\d\.)[2-9]\d{{2}}{c}\d{{3}}{c}\d{{4}}(?![\w-])(?!\.\d)" for c in (" ", r"\.", "-")),
    r"(?<![\w+])\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,5}(?!\d)",
    r"(?<![\w+-])(?<!\d\.)0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-])(?!\.\d)",
)
#: Calling codes of one and two digits; the others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
#: What each kind looks like, the first that fits wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?<!\.)@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?<!-)\.){1,20}[A-Za-z]{2,63}",
    "phone": "|".join(_PHONES),
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::{_HEX}(?::{_HEX}){{0,6}})(?![0-9A-Za-z:])(?!\.\d)",
    "ip": rf"(?<!\d)(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d)(?!\.\d)",
    "card": r"(?<!\d)(?:(?:5[0678]|6\d)\d\d(?:[ -]\d{4}){3}[ -]\d{1,3}(?![\d-])|(?:\d{4}[ -]?){3}\d{4}|3\d{3}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]{0,63}\d)(?=\d{0,63}[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_WORD}(?: (?:\p{{Lu}}\. ){{0,4}}{_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_QUICK = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}|[0-9a-f]{{32}}|AKIA"
#: Session setting that holds the key of the surrogates.
KEY_SETTING = "cohortlens.surrogates.key"
#: Draws in all, and those after which longer surrogates are drawn.
ATTEMPTS, CROWDED = 64, 8


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings; where there is none, a secret one is drawn for the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(16))
    return spark.conf.get(KEY_SETTING)


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _kind(e: Column) -> Column:
    out = F
    for k, p in PATTERNS.items():
        out = out.when(e.rlike(f"^(?:{p})$"), F.lit(k))
    return out


def _byte(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i; the digest is 64 hex digits, used in a ring."""
    return F.conv(F.substring(F.concat(digest, digest), F.pmod(i * 4, F.lit(64)) + 1, F.lit(4)), 16, 10).cast("int")


def _spell(pattern: Column, digest: Column) -> Column:
    """Each digit, small letter and capital of the pattern replaced by one of its kind."""

    def sign(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        return F.when(c.between("0", "9"), pick("0123456789")).when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(pattern, ""), sign), "")


def _luhn(digits: Column) -> Column:
    """The check digit for a run of digits."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _made_name(kind: Column, digest: Column, attempt: Column) -> Column:
    """kind is ``name-<script>-<m, f, n or l>``; four syllables, and two more each time that many draws were in vain."""

    def syllable(script: str):
        table, n = F.array(*[F.lit(s) for s in SYLLABLES[script]]), len(SYLLABLES[script])
        return lambda i: F.element_at(table, F.pmod(_byte(digest, i), F.lit(n)) + 1)

    out = F
    for (script, role), end in ENDINGS.items():
        length = F.lit(4) + F.least((attempt / CROWDED).cast("int"), F.lit(3)) * 2
        part = F.transform(F.sequence(F.lit(0), length - 1), syllable(script))
        out = out.when(kind == f"name-{script}-{role}", F.initcap(F.concat(F.array_join(part, ""), F.lit(end))))
    return out


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), kind, canon, attempt.cast("string")), 256)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    home = F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("domain"), domain), 256)
    longer = F.when(attempt >= CROWDED, _spell(F.lit("aaaa"), F.sha2(digest, 256))).otherwise("")  # short names run out of equally short ones
    email = F.concat(_spell(local, digest), longer, F.lit("@"), _spell(F.lit("aaaaaaaa"), home), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))
    n = F.length(canon)
    body = F.concat(F.left(canon, F.lit(1)), _spell(F.substring(canon, F.lit(2), n - 2), digest))
    check = F.pmod(_luhn(body) + F.right(canon, F.lit(1)).cast("int") - _luhn(F.left(canon, n - 1)), F.lit(10))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string")), ".")
    secret = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.lower(F.hex(F.pmod(_byte(F.sha2(F.concat(digest, (i / 16).cast("int").cast("string")), 256), i), F.lit(16))))), "")
    key_signs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.pmod(_byte(digest, i), F.lit(32)) + 1, F.lit(1))), "")
    return (
        F.when(kind == "email", email)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ip", octets)
        .when(kind == "ipv6", F.concat(F.lit("2001:0db8:"), F.regexp_replace(F.left(digest, F.lit(24)), "(.{4})(?!$)", "$1:")))
        .when(kind == "key", F.concat(F.lit("AKIA"), key_signs))
        .when(kind == "secret", secret)
        .when(kind == "phone", F.concat(F.substring_index(canon, "|", 1), F.lit("|"), _spell(F.substring_index(canon, "|", -1), digest)))
        .when(kind.startswith("name-"), _made_name(kind, digest, attempt))
        .otherwise(_spell(canon, digest))
    )


def assign(found: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, canon, made): a surrogate for each distinct entity, distinct within its kind and no entity itself.

    Digits of a form that has no free surrogate left after so many draws (a form of few digits, most
    of which are real) get the next real one of their form that has none either, in a ring.
    """
    form = lambda x: F.when(F.col("kind").startswith("name-"), F.initcap(x)).otherwise(x)
    with Tables(found.sparkSession) as tables:
        real = found.select("kind", form(F.col("canon")).alias("made"))
        pending, settled = found.withColumn("attempt", F.lit(0)), None
        for _ in range(attempts):
            tried = tables.save(pending.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
            taken = real if settled is None else real.unionByName(settled.select("kind", "made"))
            first = tried.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
            good = tables.save(first.join(taken, ["kind", "made"], "left_anti").select("kind", "canon", "made"), "fresh")
            settled = good if settled is None else settled.unionByName(good)
            pending = tables.save(tried.join(good, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "collisions")
            if pending.isEmpty():
                break
        else:
            w = Window.partitionBy("kind", F.regexp_replace("canon", "[0-9]", "0"))
            nxt = F.coalesce(F.lead("canon").over(w.orderBy("canon")), F.min("canon").over(w))
            settled = settled.unionByName(pending.select("kind", "canon", nxt.alias("made")))
        return save(settled, "settled")[0]


def _surfaces(distinct: DataFrame) -> DataFrame:
    """(e, kind, k1, c1, k2, c2): each surface form with the canonical entities that it names, none for a run of digits that is no card."""
    kind = _kind(F.col("e"))
    with_kind = distinct.select("e", kind.alias("kind"))
    words = F.split("e", " ")
    title = F.regexp_replace(words[0], "\\.$", "")
    script = F.when(F.element_at(words, -1).rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(title.isin(*TITLES_M), "m").when(title.isin(*TITLES_N), "n").otherwise("f")
    last, first = F.lower(F.element_at(words, -1)), F.when(F.size(words) > 2, F.lower(words[1]))
    digits = F.regexp_replace("e", "[^0-9]", "")
    number = F.when(F.col("e").startswith("+"), F.regexp_replace(digits, _COUNTRY, "$1|")).otherwise(F.concat(F.lit("|"), digits))
    left, right = (F.filter(F.split(x, ":"), lambda g: g != "") for x in (F.substring_index("e", "::", 1), F.when(F.contains("e", F.lit("::")), F.substring_index("e", "::", -1)).otherwise("")))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    address = F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(F.lower(g), 4, "0")), ":")
    canon = F.when(F.col("kind") == "phone", number).when(F.col("kind").isin("card", "ssn"), digits).when(F.col("kind") == "ipv6", address).when(F.col("kind") == "email", F.lower("e")).otherwise(F.col("e"))
    named = F.col("kind") == "name"
    wrong = (F.col("kind") == "card") & F.col("e").rlike("^\\d+$") & (_luhn(F.left(digits, F.length(digits) - 1)) != F.right(digits, F.lit(1)).cast("int"))
    return with_kind.select(
        "e", "kind",
        F.when(named, F.concat(F.lit("name-"), script, F.lit("-l"))).when(~wrong, F.col("kind")).alias("k1"),
        F.when(named, last).otherwise(canon).alias("c1"),
        F.when(named & first.isNotNull(), F.concat(F.lit("name-"), script, F.lit("-"), gender)).alias("k2"),
        F.when(named, first).alias("c2"),
    )


def _dressed(made: Column, made2: Column) -> Column:
    """The surrogate in the format of the surface form ``e``."""
    e = F.col("e")
    digit_no = lambda i: F.length(F.regexp_replace(F.left(e, i + 1), "[^0-9]", ""))
    plain = F.replace(made, F.lit("|"), F.lit(""))
    digits = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(plain, digit_no(i), F.lit(1))).otherwise(c)), "")
    return (
        F.when(F.col("kind").isin("phone", "card", "ssn"), digits)
        .when(F.col("kind") == "name", F.concat_ws(" ", F.substring_index(e, " ", 1), made2, made))
        .otherwise(made)
    )


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced; ``count_col`` names a column for how many there were."""
    text = F.col(text_col)
    es, k1, k2, sur, names = free_name(docs, "entities", "key_1", "key_2", "surrogates", "names")
    # one text twice needs one answer: what follows is keyed by the list of a text's entities
    found = F.when(text.rlike(_QUICK), entities(text))
    tagged, _ = save(docs.withColumn(es, F.when(F.size(found) > 0, found)), "tagged-texts")
    marked = tagged.where(F.col(es).isNotNull())
    with Tables(docs.sparkSession) as tables:
        answers, _ = save(_answers(marked.select(F.col(es).alias("es")), key, tables).toDF(k1, k2, sur, names), "answers")
    gaps = F.split(text, ANY, -1)
    known = F.transform(names, lambda x: x["word"])
    bare = lambda t: t.rlike("^\\p{Lu}") & F.array_contains(known, F.lower(t))
    tokens = lambda g: F.regexp_extract_all(g, F.lit(_TOKENS), F.lit(0))
    meant = lambda t: F.when(bare(t), F.get(F.filter(names, lambda x: x["word"] == F.lower(t)), F.lit(0))["by"]).otherwise(t)
    mentions = lambda g: F.exists(known, lambda w: F.contains(F.lower(g), w))
    unnamed = lambda g: F.when(mentions(g), F.array_join(F.transform(tokens(g), meant), "")).otherwise(g)
    filled = F.array_join(F.zip_with(gaps, F.array_append(sur, F.lit("")), lambda a, b: F.concat(unnamed(a), b)), "")
    done = marked.withColumns(dict(zip((k1, k2), _list_key(F.col(es)), strict=True))).join(answers, [k1, k2])
    rest = tagged.where(F.col(es).isNull())
    if count_col:
        in_gaps = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.when(mentions(g), F.size(F.filter(tokens(g), bare))).otherwise(0))
        replaced = F.size(F.filter(F.zip_with(es, sur, lambda a, b: a != b), lambda x: x))
        done, rest = done.withColumn(count_col, replaced + in_gaps), rest.withColumn(count_col, F.lit(0))
    out = [*docs.columns, *([count_col] if count_col and count_col not in docs.columns else [])]
    return rest.select(*out).unionByName(done.withColumn(text_col, filled).select(*out))


def _list_key(es: Column) -> list[Column]:
    return [F.xxhash64(es), F.xxhash64(F.lit(1), es)]


def _answers(lists: DataFrame, key: str, tables: Tables) -> DataFrame:
    """(k1, k2, surrogates, names) of each list of entities: what stands for each, and for the words of the names in it."""
    k = _list_key(F.col("es"))
    lists = lists.groupBy(k[0].alias("k1"), k[1].alias("k2")).agg(F.first("es").alias("es"))
    each = tables.save(lists.select("k1", "k2", F.posexplode("es").alias("pos", "e")), "entities")
    surfaces = tables.save(_surfaces(each.select("e").distinct()).withColumnsRenamed({"k1": "kind_1", "k2": "kind_2"}), "surfaces")
    found = surfaces.where("kind_1 is not null").select(F.col("kind_1").alias("kind"), F.col("c1").alias("canon")).union(surfaces.where("kind_2 is not null").select("kind_2", "c2")).distinct()
    made = assign(found, key)
    one, two = made.select(F.col("kind").alias("kind_1"), F.col("canon").alias("c1"), "made"), made.select(F.col("kind").alias("kind_2"), F.col("canon").alias("c2"), F.col("made").alias("made2"))
    # bare mentions: the words of a name, in lower case, with what stands for them
    pair = lambda word, by: F.struct(word.alias("word"), by.alias("by"))
    parts = F.when(F.col("kind") == "name", F.filter(F.array(pair(F.col("c1"), F.col("made")), pair(F.col("c2"), F.col("made2"))), lambda x: x["word"].isNotNull()))
    dressed = surfaces.join(one, ["kind_1", "c1"], "left").join(two, ["kind_2", "c2"], "left").select("e", F.when(F.col("kind_1").isNull(), F.col("e")).otherwise(_dressed(F.col("made"), F.col("made2"))).alias("sur"), parts.alias("parts"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "sur", "parts")))
    answers = each.join(dressed, "e").groupBy("k1", "k2").agg(listed.alias("l"))
    return answers.select("k1", "k2", F.transform("l", lambda x: x["sur"]), F.array_distinct(F.flatten(F.filter(F.transform("l", lambda x: x["parts"]), lambda x: x.isNotNull()))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark), count_col="n_entities").select("doc_id", "n_entities", "text")
