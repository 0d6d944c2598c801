"""Surrogates for personal data (operator 6, DataFrame functions only).

Entities are found by regular expressions, brought to a canonical form (digits of a phone number, lower-cased address) and gathered once over all documents in a
dictionary. A keyed hash proposes a surrogate of the same kind for each entry. Proposals that meet each other or a real entity are drawn again until all
differ (from a wider format where the own one runs out), so equal entities keep one surrogate everywhere and different ones never share it. Mentions then get the surrogate in their own spelling: separators, case,
script and length stay. Names carry a title that tells the gender; each name word is an entity of its own, so "Mr. John Smith" and "Mr. Smith" stay one man.
Only documents with entities are joined and rebuilt, the others pass as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Titles by gender, words before a secret (values without quotation marks hold a digit), and patterns by kind, tried from left to right at each place. A title, such a word or the first line of
#: a private key belongs to the match, as its prefix, and stays. Each pattern fails at its first character almost everywhere, as whole texts are searched; no secret is too
#: long to be found, and repetitions without an upper bound give nothing back, so long texts cost no more than their length.
MEN, WOMEN, BOTH = r"Mr\.?|Mister|Herrn?|Monsieur|Señor|Signor|господин|г-н", r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Signora|госпожа|г-жа", r"Dr\.?|Prof\.?|Professor"
SETS = r"(?i:token|secret|password|passwd|pwd|api[_-]?key)[\"']?\s{0,2}(?:=>|:=|[=:])\s{0,2}"
KEYWORD = SETS + r"[\"']?"
#: What the name of a street ends in; it stays.
STREETS = r"Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive"
#: A word of a name, and how a name is cut into its words.
NAME, NAME_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+", r"\p{L}+(?:['’]\p{L}+)*"
PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
HEX4 = "[0-9A-Fa-f]{1,4}"
KINDS = {
    "pem": PEM + r"[A-Za-z0-9+/=\s]++(?=-----END )",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}.-]{0,252}[\p{L}\p{N}])?\.\p{L}{2,24}(?![\p{L}\p{N}])",
    "keyword": SETS + r"""(?:"[^"\n]{6,}+(?=")|'[^'\n]{6,}+(?=')|(?=[^\s"'<>,;&()\[\]{}=:]*?[0-9])[^\s"'<>,;&()\[\]{}]{6,}+)""",
    "secret": r"\b(?:AKIA[0-9A-Z]{16,}+|gh[pousr]_[0-9A-Za-z]{36,}+|github_pat_[0-9A-Za-z_]{22,}+|sk-[0-9A-Za-z_-]{20,}+|xox[abeoprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{30,}+|(?<!-)eyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+|(?=[0-9A-Fa-f]{32})(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+)(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "card": r"(?=\d)(?<![\w.-])(?:\d{13,19}|\d{4}(?<sep>[ -])\d{4}\k<sep>\d{4}\k<sep>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": rf"(?=[23fF])(?<![\w:.])(?:[23][0-9A-Fa-f]{{3}}|[fF][eE][89ABab][0-9A-Fa-f]|[fF][CDcd][0-9A-Fa-f]{{2}})(?=(?::{HEX4}){{0,6}}::|(?::{HEX4}){{7}}(?![\w:]))(?:::?{HEX4}){{1,7}}(?![\w:])",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])(?:\d{3}-\d{3}-\d{4}|0\d{1,2}-\d{3,4}-\d{4})(?![\w-])"
             r"|(?<![\w.,/-])(?:\d{3}\.\d{3}\.\d{4}|0\d{2,4}[ /]\d{5,8})(?![\w/-]|[.,]\d))",
    "name": rf"(?=[MHSFDPг])(?<![\p{{L}}\p{{N}}])(?:{MEN}|{WOMEN}|{BOTH}) (?:{NAME}(?:[ -]{NAME}){{0,2}}|\p{{IsHangul}}{{2,4}}(?!\p{{L}}))",
    "street": rf"(?=\d)(?<![\w.,/-])\d{{1,5}}(?: \p{{Lu}}\p{{Ll}}+){{1,3}}(?= (?:{STREETS})(?!\w))",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
PREFIX = rf"^(?:(?:{MEN}|{WOMEN}|{BOTH}) (?=[\p{{Lu}}\p{{IsHangul}}])|{KEYWORD}|{PEM})"
#: What every match holds: a digit, an at sign, a quotation mark, two colons with at most four letters between, or one of these words. Most documents have none of them.
MARKS = "[0-9@\"']|:[A-Fa-f]{0,4}:"
STARTS = (
    "Mr", "Mister", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Señor", "Signor", "господин", "госпожа", "г-н", "г-жа", "Dr", "Prof",
    "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xox", "AIza", "eyJ", "-----BEGIN ",
)
DIGITS = ("card", "ssn", "phone")
#: Given names that surrogates are drawn from, and syllables of their family names, by script.
GIVEN = {
    ("male", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Nico", "Oskar", "Paul"],
    ("female", "latin"): ["Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("female", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Инна", "Ксения"],
    ("both", "latin"): ["Alex", "Andrea", "Charlie", "Eli", "Jamie", "Kim", "Luca", "Noa", "Robin", "Sascha"],
    ("both", "cyrillic"): ["Валя", "Женя", "Саша", "Слава"],
}
SYLLABLES = {
    "latin": ["ba", "den", "ker", "lin", "mar", "nor", "ros", "sel", "tan", "ver", "wal", "zim", "hol", "gar", "fer", "dor"],
    "cyrillic": ["ба", "вен", "гор", "дол", "кар", "лин", "мар", "нов", "пет", "рос", "сел", "тар", "фед", "хар", "чер", "шан"],
    "hangul": ["강", "고", "김", "남", "도", "민", "박", "서", "수", "신", "영", "우", "윤", "정", "준", "현"],
}
#: Largest dictionary that is broadcast to the mentions, in rows. Entities of a task that draws surrogates: at least, and at most where there are enough tasks.
MAX_ENTITIES, LEAST_DRAWN, MOST_DRAWN = 200_000, 500, 20_000
#: Draws after which an entity takes a surrogate of a wider format, as the format may have no more members: other characters change too, then more are added.
WIDER, LONGER = 3, 10
DOC = ["doc_id", "text_hash"]


def private(text: Column) -> Column:
    """Whether a text holds an entity; false for null. Cheap tests come first."""
    marked = reduce(lambda a, w: a | F.contains(text, F.lit(w)), STARTS, text.rlike(MARKS))
    return F.coalesce(marked & text.rlike(ANY), F.lit(False))


def kind_of(prefix: Column, mention: Column) -> Column:
    """The kind of what ANY has matched behind its prefix."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(prefix.rlike(r"[\"'=:>-]\s*$"), "secret")
        .when(prefix != "", "name")
        .when(F.contains(mention, F.lit("@")) & mention.rlike(r"^[^\s@]+@[^\s@]+\.\p{L}+$"), "email")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d{1,5} \p{Lu}\p{Ll}"), "street")
        .when(mention.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d[\d -]*$") & (F.length(digits) >= 13) & (F.length(digits) <= 19), "card")
        .when(mention.rlike(r"^[+(]?\d[\d ()./-]*$") & ~mention.rlike(r"^\d+$"), "phone")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}[ 0-9A-Z]{11,36}$") & (F.length(F.regexp_replace(mention, " ", "")) >= 15) & (F.length(F.regexp_replace(mention, " ", "")) <= 34), "iban")
        .otherwise("secret")
    )


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share."""
    return F.when(kind.isin(*DIGITS), F.regexp_replace(mention, r"\D", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(F.lower(mention))


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """Keyed hexadecimal digits, the same for the same entity and attempt."""
    text = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(F.sha2(text, 512), F.sha2(F.concat(F.lit("+"), text), 512))


def _byte(stream: Column, i: Column) -> Column:
    """Number i of the stream, from 0 to 65535; positions beyond its end start again."""
    return F.conv(F.substring(stream, (i % 63) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _shaped(entity: Column, stream: Column, keep: Column) -> Column:
    """Replaces letters and digits one by one by others of their class and script; the first keep characters and all others stay.

    Later draws (attempt) replace all characters but white space, still later ones also add digits: so there is always another surrogate.
    """
    pools = [(r"[0-9]", "0123456789"), (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")]

    hexadecimal, attempt = entity.rlike("^[0-9a-f]{32,}$|^[0-9a-f:]*:[0-9a-f:]*$"), F.col("attempt")

    def one(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit("abcdef"), _byte(stream, i) % 6 + 1, F.lit(1))
        any_of = F.substring(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), _byte(stream, i) % 36 + 1, F.lit(1))
        rest = F.when((attempt >= WIDER) & ~c.rlike(r"\s"), any_of).otherwise(c)
        new = reduce(lambda rest, p: F.when(c.rlike(p[0]), F.substring(F.lit(p[1]), _byte(stream, i) % len(p[1]) + 1, F.lit(1))).otherwise(rest), reversed(pools), rest)
        return F.when(i < keep, c).when(hexadecimal & c.rlike("[a-f]"), letter).otherwise(new)

    more = F.when(attempt >= LONGER, F.translate(F.substring(F.reverse(stream), F.lit(1), F.floor(attempt / LONGER).cast("int") * 4), "abcdef", "012345")).otherwise("")
    return F.concat(F.array_join(F.transform(F.split(entity, ""), one), ""), more)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.array_max(F.array(c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5).cast("int"), F.lit(0)))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _propose(key: str, d: DataFrame) -> Column:
    """A surrogate in canonical form for kind, entity, part (names: given or family), gender, script, attempt and checked (valid check digit)."""
    kind, entity = F.col("kind"), F.col("entity")
    s = _stream(key, kind, entity, F.col("attempt"))
    domain = F.concat(F.lit("mail"), F.conv(F.substring(s, 60, 6), 16, 10), F.lit(".example."), F.regexp_extract(entity, r"([\p{L}]+)$", 1))
    local = F.regexp_extract(entity, r"^([^@]*)@", 1)
    email = F.concat(_shaped(local, s, F.lit(0)), F.lit("@"), domain)
    v6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(s, 1 + 4 * i, 4)) for i in range(6)])
    v4 = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    ip = F.when(F.col("attempt") >= LONGER, v6).when(kind == "ip", v4).when(F.col("attempt") >= WIDER, v6).when(
        entity.rlike("^[23]"), F.concat(F.lit("2001:db8"), _shaped(F.regexp_replace(entity, "^[0-9a-f]{4}(:[0-9a-f]+)?", ""), s, F.lit(0)))
    ).otherwise(_shaped(entity, s, F.lit(4)))
    number = _shaped(entity, s, F.when(kind == "phone", F.length(entity) - F.least(F.length(entity), F.lit(9))).when(kind == "card", 1).otherwise(0))
    base = F.concat(F.substring(number, F.lit(1), F.length(number) - 1), F.lit("0"))
    card = F.when(F.col("checked"), F.concat(F.substring(base, F.lit(1), F.length(base) - 1), ((F.lit(10) - _luhn(base)) % 10).cast("string"))).otherwise(number)
    given = reduce(lambda rest, g: F.when((F.col("gender") == g[0]) & (F.col("script") == g[1]), F.element_at(F.array(*[F.lit(x) for x in GIVEN[g]]), _byte(s, F.lit(0)) % len(GIVEN[g]) + 1)).otherwise(rest), GIVEN, F.lit(""))

    def syllables(script: str, n: Column) -> Column:
        pool = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(pool, _byte(s, i) % 16 + 1)), "")

    # A longer name each few attempts: names never run out.
    more = F.lit(3) + F.floor(F.col("attempt") / 3).cast("int")
    family = reduce(lambda rest, script: F.when(F.col("script") == script, syllables(script, more)).otherwise(rest), SYLLABLES, F.lit(""))
    street = F.concat(_shaped(F.regexp_extract(entity, r"^\d+", 0), s, F.lit(0)), F.lit(" "), syllables("latin", more))
    given = F.when(given == "", family).otherwise(F.concat(given, F.when(F.col("attempt") >= 2, F.concat(F.lit("-"), F.initcap(family))).otherwise(F.lit(""))))
    name = F.when(F.col("part") == "given", F.lower(given)).otherwise(family)
    iban = F.concat(F.substring(entity, 1, 2), F.substring(_shaped(entity, s, F.lit(2)), F.lit(3), F.length(entity)))
    return F.when(kind == "email", email).when(kind.isin("ip", "ipv6"), ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), number).when(kind == "name", name).when(kind == "iban", iban).when(kind == "street", street).otherwise(_shaped(entity, s, F.lit(0)))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, i (place in the text's row of entities), prefix (title or keyword), mention, kind, gender (names) of each entity of each different text."""
    found = docs.where(private(F.col("text"))).select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("m"))
    one = found.dropDuplicates(DOC).select(*DOC, F.posexplode("m").alias("i", "whole"))
    cut = one.withColumn("prefix", F.regexp_extract("whole", PREFIX, 0)).withColumn("mention", F.expr("substring(whole, length(prefix) + 1)"))
    kind = kind_of(F.col("prefix"), F.col("mention"))
    gender = F.when(F.col("prefix").rlike(rf"^(?:{WOMEN}) $"), "female").when(F.col("prefix").rlike(rf"^(?:{BOTH}) $"), "both").otherwise("male")
    return cut.select(*DOC, "i", "prefix", "mention", kind.alias("kind"), F.when(kind == "name", gender).alias("gender"))


def _words(found: DataFrame) -> DataFrame:
    """Mentions by the entities they consist of: names word by word, the others whole. Adds j, word, entity, part, script."""
    name = F.col("kind") == "name"
    split = F.when(name, F.regexp_extract_all("mention", F.lit(NAME_WORD), F.lit(0))).otherwise(F.array("mention"))
    each = found.select("*", F.size(split).alias("n"), F.posexplode(split).alias("j", "word"))
    part = F.when(name, F.when(F.col("j") == F.col("n") - 1, "family").otherwise("given")).otherwise("")
    script = F.when(name & F.col("word").rlike(r"\p{IsCyrillic}"), "cyrillic").when(name & F.col("word").rlike(r"\p{IsHangul}"), "hangul").otherwise("latin")
    return each.withColumn("entity", canonical(F.col("kind"), F.col("word"))).withColumn("part", part).withColumn("script", script)


def dictionary(words: DataFrame, key: str) -> DataFrame:
    """kind, entity, part, gender and surrogate of each different entity; surrogates of a kind differ from one another and from all its real entities.

    A given name is an entity of its gender; a family name has none. Where proposals meet, the smallest entity keeps its own and the others draw again.
    """
    gender = F.when(F.col("part") == "given", F.col("gender")).otherwise("")
    fresh = words.select("kind", "entity", "part", gender.alias("gender"), "script").groupBy("kind", "entity", "part", "gender").agg(F.min("script").alias("script"))
    checked = F.when(F.col("kind") == "card", _luhn(F.col("entity")) == 0).otherwise(False)
    left = common.store(fresh.withColumn("attempt", F.lit(0)).withColumn("checked", checked), "entities")
    real, cols, done = left.select("kind", "entity").distinct(), left.columns, None
    while True:
        # Few rows cost much here, so a small table is dealt to many tasks.
        n = left.count()
        tasks = max(1, min(n // LEAST_DRAWN, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // MOST_DRAWN)))
        drawn = left.repartition(tasks, "kind", "entity").withColumn("surrogate", _propose(key, left))
        order = Window.partitionBy("kind", "surrogate").orderBy("entity", "part", "gender")
        drawn = drawn.withColumn("r", F.row_number().over(order))
        taken = real.withColumnRenamed("entity", "surrogate")
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate")).distinct()
        drawn = common.store(drawn.join(taken.withColumn("__taken", F.lit(True)), ["kind", "surrogate"], "left"), "drawn")
        good = drawn.where("r = 1 AND __taken IS NULL").select(*cols, "surrogate")
        done = good if done is None else done.unionByName(good)
        left = drawn.where("r > 1 OR __taken IS NOT NULL").select(*cols).withColumn("attempt", F.col("attempt") + 1)
        if left.isEmpty():
            return done.select("kind", "entity", "part", "gender", "surrogate")


def _spelled(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the mention: its separators, or its case."""
    place = lambda i, drop: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), drop, ""))
    digits = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(surrogate, place(i, r"\D"), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(surrogate, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.length(surrogate)))
    iban = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c != " ", F.substring(surrogate, place(i, " "), F.lit(1))).otherwise(c)), "")
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).when((kind == "street") | (kind == "name") & mention.rlike(r"^\p{Lu}"), F.initcap(surrogate)).otherwise(surrogate)
    mixed = F.array_join(F.zip_with(F.split(mention, ""), F.split(surrogate, ""), lambda m, c: F.when(m.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin(*DIGITS), digits).when(kind == "iban", iban).when(kind == "secret", mixed).otherwise(cased)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and two more columns: n_entities (long) and entity_kinds (sorted array of the kinds in the row).

    key is the secret that makes surrogates unguessable and repeatable. Null texts stay null; texts without entities, also empty ones, stay as they are; repeated rows
    change alike; empty docs give an empty result; doc_id may be null. Columns called n_entities or entity_kinds are replaced.
    """
    docs = docs.drop("n_entities", "entity_kinds")
    found = common.store(mentions(docs), "mentions")
    words = common.store(_words(found), "entity-words")
    book = common.store(dictionary(words, key), "surrogates")
    keyed = words.withColumn("__gender", F.when(F.col("part") == "given", F.col("gender")).otherwise(""))
    named = keyed.join(common.small(book.withColumnRenamed("gender", "__gender"), MAX_ENTITIES), ["kind", "entity", "part", "__gender"])
    spelled = named.withColumn("new", _spelled(F.col("kind"), F.col("word"), F.col("surrogate")))
    # Put names together again: the separators between their words are those of the mention.
    whole = spelled.groupBy(*DOC, "i", "prefix", "mention", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "new"))), lambda x: x["new"]).alias("parts"))
    gaps = F.split("mention", NAME_WORD, -1)
    name = F.array_join(F.zip_with(gaps, F.concat(F.col("parts"), F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    whole = whole.withColumn("new", F.concat("prefix", F.when(F.col("kind") == "name", name).otherwise(F.element_at("parts", 1))))
    per_doc = whole.groupBy(*DOC).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("__new"), F.sort_array(F.collect_set("kind")).alias("entity_kinds"))
    per_doc = per_doc.select(*DOC, "__new", "entity_kinds").withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    touched = docs.where(private(F.col("text"))).withColumn("__own", F.xxhash64("text"))
    joined = touched.join(per_doc, touched["doc_id"].eqNullSafe(per_doc["__doc"]) & (touched["__own"] == per_doc["__hash"]))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), F.concat(F.col("__new"), F.array(F.lit(""))), lambda g, e: F.concat(g, e)), "")
    cols = docs.columns
    changed = joined.withColumn("text", text).withColumn("n_entities", F.size("__new").cast("long")).select(*cols, "n_entities", "entity_kinds")
    same = docs.where(~private(F.col("text")))
    return same.withColumn("n_entities", F.lit(0).cast("long")).withColumn("entity_kinds", F.expr("array()").cast("array<string>")).unionByName(changed)
