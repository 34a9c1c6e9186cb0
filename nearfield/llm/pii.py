"""Surrogates for personal data, by DataFrame functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

ROUNDS = 60
#: Collided values up to this number are looked up in a broadcast map, more by a shuffle.
BROADCAST_VALUES = 500
#: The session's setting that holds the key of query() and of the pipeline, and what stands in for the supplied invented tables where it is unset.
KEY_SETTING, DEMO_KEY = "spark.nearfield.pii.key", "for invented data only"

_L = r"\p{L}\p{M}\p{N}"
_NOT_IN_WORD = r"(?<![\p{L}\p{N}_])"
_NAME = r"\s\p{Lu}[\p{L}'-]+(?:\s\p{Lu}[\p{L}'-]+)?"
#: What is found, in this order where two could start at one place. Boundaries are looked at, not taken.
PATTERNS = {
    "email": rf"(?<![{_L}._%+-])[{_L}._%+-]++@[{_L}-]+(?:\.[{_L}-]+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z+(])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+(.-])(?:[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /-][0-9]{5,9})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "woman": rf"{_NOT_IN_WORD}(?:Mrs\.?|Ms\.?|Miss|Madame|Mme\.?|Frau|Señora|Sra\.?|Госпожа){_NAME}",
    "man": rf"{_NOT_IN_WORD}(?:Mr\.?|Monsieur|Herr|Señor|Sr\.|Господин){_NAME}",
    "any": rf"{_NOT_IN_WORD}(?:Dr\.?|Prof\.?|Professor){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no mention: each pattern needs a digit, an @, a long run of hex letters or the beginning of a title.
SUSPECT = "[0-9@]|[A-Fa-f]{32}|(?:Mr|Ms|Miss|Mme|Frau|Herr|Mons|Madame|Seño|Sra|Sr\\.|Госп|Dr|Prof)"
GENDERS = ("woman", "man", "any")
#: First names by gender and script, and letters and endings of last names by script.
FIRST = {
    "woman": ["Anna", "Clara", "Diana", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rita", "Sara", "Vera", "Lena", "Eva"],
    "man": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Tom", "Viktor"],
    "any": ["Alex", "Ari", "Chris", "Dana", "Jamie", "Jo", "Kai", "Kim", "Luca", "Mika", "Noa", "Quinn", "Robin", "Sam", "Sasha", "Toni"],
    "woman_ru": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Татьяна", "Ульяна", "Юлия", "Яна"],
    "man_ru": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"],
    "any_ru": ["Женя", "Саша", "Валя", "Слава", "Шура", "Паша", "Миша", "Лера", "Ника", "Тоня", "Люся", "Вася", "Даня", "Сеня", "Митя", "Гена"],
}
LATIN = ("bcdfghklmnprstvz", "aeio")
CYRILLIC = ("бвгдзжклмнпрстфх", "аеиу")
#: Letters and digits that stand in for each other, by script.
ALPHABETS = {
    "[0-9]": "0123456789",
    r"\p{IsLatin}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    "[٠-٩]": "٠١٢٣٤٥٦٧٨٩",
    "[۰-۹]": "۰۱۲۳۴۵۶۷۸۹",
    r"\p{IsArabic}": "بتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "[०-९]": "०१२३४५६७८९",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    r"\p{IsThai}": "กขคงจชซดตถทนบปผพฟมยรลวสหอ",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조",
    r"\p{IsHan}": "山川田中村林木石金水火土大小上下东西南北王李张刘陈杨",
    "[０-９]": "０１２３４５６７８９",
}


def key_of(spark: SparkSession) -> str:
    """The session's key. Who knows it can tell which surrogate belongs to which value, so it belongs to the caller and not into a repository."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def kind_of(m: Column) -> Column:
    """The first type whose pattern the whole mention matches."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _word(m: Column, i: int) -> Column:
    """Of a mention of a name: its title with what follows (1), first name (2), what follows (3) and last name (4)."""
    return F.regexp_extract(m, r"^(\S+\s)(?:(\S+)(\s))?(\S+)$", i)


def _russian(word: Column) -> Column:
    return word.rlike(r"^\p{IsCyrillic}")


def entities(kind: Column, m: Column) -> Column:
    """The entities of a mention as an array of (kind, value): two for a full name, else one.

    Mentions of one entity have one value: small letters for e-mail and secrets, digits and a plus for numbers, small letters for names. A
    last name is an entity of its own, so it is the same with and without a first name, whatever the title; Russian ones, whose endings tell the gender,
    have two kinds. A first name belongs to its last name.
    """
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    value = (
        F.when(kind.isin("email", "secret"), F.lower(m))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, r"[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )
    first, last = F.lower(_word(m, 2)), F.lower(_word(m, 4))
    last_kind = F.when(_russian(last), F.concat(F.lit("last_"), kind)).otherwise("last")
    whole = one(last_kind, last)
    name = F.when(first == "", F.array(whole)).otherwise(F.array(whole, one(F.concat(F.lit("first_"), kind), F.concat(last, F.lit("|"), first))))
    return F.when(kind.isin(*GENDERS), name).otherwise(F.array(one(kind, value)))


def _digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 512)


def _byte(digest: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64 * 2 + 1
    return F.conv(F.substr(digest, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(letters: str, digest: Column, i: Column | int) -> Column:
    return F.substr(F.lit(letters), _byte(digest, i) % len(letters) + 1, F.lit(1))


def _same_format(m: Column, digest: Column, keep: Column) -> Column:
    """m with its letters and digits replaced by others of their script and case, the first ``keep`` characters staying. The n-th letter or digit takes the digest's n-th byte, so formats don't matter."""
    ordinal = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), r"[^\p{L}\p{N}]", ""))

    def swap(c: Column, i: Column) -> Column:
        new = F.when(c.rlike(r"[\p{L}\p{N}]"), _letter(ALPHABETS[r"\p{IsLatin}"], digest, ordinal(i))).otherwise(c)
        for script, letters in reversed(ALPHABETS.items()):
            new = F.when(c.rlike(f"(?=[\\p{{L}}\\p{{N}}]){script}"), _letter(letters, digest, ordinal(i))).otherwise(new)
        return F.when(i < keep, c).when(c.rlike(r"\p{M}"), F.lit("")).when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(m, ""), swap), "")


def _first_name(kind: Column, russian: Column, digest: Column, attempt: Column) -> Column:
    """A first name of the gender and script; later attempts have one more of them each."""
    def names(held: list[str]) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(F.array(*map(F.lit, held)), _byte(digest, i) % len(held) + 1)), "-")

    out = F.lit(None).cast("string")
    for gender in GENDERS:
        out = F.when(kind == f"first_{gender}", F.when(russian, names(FIRST[f"{gender}_ru"])).otherwise(names(FIRST[gender]))).otherwise(out)
    return out


def _last_name(kind: Column, russian: Column, digest: Column, attempt: Column) -> Column:
    """A last name of four syllables and an ending in the script; later attempts have two more syllables each."""
    def syllables(letters):
        return F.array_join(F.transform(F.sequence(F.lit(1), 4 + 2 * attempt), lambda i: F.concat(_letter(letters[0], digest, 2 * i), _letter(letters[1], digest, 2 * i + 1))), "")

    ending = F.element_at(F.array(*map(F.lit, ["n", "r", "s", "t"])), _byte(digest, 0) % 4 + 1)
    return F.initcap(F.when(russian, F.concat(syllables(CYRILLIC), F.when(kind == "last_woman", "нова").otherwise("нов"))).otherwise(F.concat(syllables(LATIN), ending)))


def _styled(old: Column, new: Column) -> Column:
    """new in capitals if old is."""
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(new)


def _word_surrogate(kind: Column, word: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate of a first or last name; scripts without names of their own keep theirs letter by letter."""
    russian = _russian(word)
    made = F.when(kind.startswith("first_"), _first_name(kind, russian, digest, attempt)).otherwise(_last_name(kind, russian, digest, attempt))
    return _styled(word, F.when(russian | word.rlike(r"^\p{IsLatin}"), made).otherwise(F.concat(_same_format(word, digest, F.lit(0)), _extra(word, digest, attempt))))


def _extra(word: Column, digest: Column, attempt: Column) -> Column:
    """Two more letters for each attempt after the first, where a format allows for them."""
    more = F.transform(F.sequence(F.lit(0), 2 * attempt), lambda i: _letter(ALPHABETS[r"\p{IsLatin}"], digest, 40 + i))
    return F.when(attempt > 0, F.array_join(more, "")).otherwise("")


def _from_digest(kind: Column, m: Column, digest: Column, attempt: Column) -> Column:
    """The replacement of a mention that is no name: the same type, case and format. A domain's ending stays, a plus with the first digit, and an IBAN's country."""
    ip = F.concat_ws(".", *[_byte(digest, i).cast("string") for i in range(4)])
    host = F.regexp_extract(m, r"(?:\.[^.@]+){1,2}$", 0)
    local = F.substr(m, F.lit(1), F.length(m) - F.length(host))
    secret = F.when(m == F.lower(m), F.substr(digest, F.lit(1), F.length(m))).otherwise(F.upper(F.substr(digest, F.lit(1), F.length(m))))
    keep = F.when(kind == "iban", 2).when((kind == "phone") & m.startswith("+"), 2).otherwise(0)
    return (
        F.when(kind == "email", F.concat(_extra(m, digest, attempt), _same_format(local, digest, F.lit(0)), host))
        .when(kind == "secret", secret)
        .when(kind == "ip", ip)
        .otherwise(_same_format(m, digest, keep))
    )


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def surrogate(key: str, kind: Column, m: Column, attempt_of) -> Column:
    """The replacement of one mention, chosen by keyed digests of its entities; attempt_of(kind, value) is an entity's attempt."""

    def word(entity: Column, old: Column) -> Column:
        k, v = entity["kind"], entity["value"]
        return _let(attempt_of(k, v), lambda a: _let(_digest(key, k, v, a), lambda d: _word_surrogate(k, old, d, a)))

    def name(found: Column) -> Column:
        first = F.when(F.size(found) > 1, F.concat(word(F.get(found, F.lit(1)), _word(m, 2)), _word(m, 3))).otherwise("")
        return F.concat(_word(m, 1), first, word(F.get(found, F.lit(0)), _word(m, 4)))

    def other(found: Column) -> Column:
        k, v = F.get(found, F.lit(0))["kind"], F.get(found, F.lit(0))["value"]
        return _let(attempt_of(k, v), lambda a: _let(_digest(key, k, v, a), lambda d: _from_digest(k, m, d, a)))

    return _let(entities(kind, m), lambda found: F.when(kind.isin(*GENDERS), name(found)).otherwise(other(found)))


def _entities(df: DataFrame, text: str) -> DataFrame:
    """(kind, value): the distinct entities of all texts."""
    found = df.where(F.col(text).rlike(SUSPECT)).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("m"))
    kinds = found.groupBy("m").agg(F.lit(1).alias("one")).select("m", kind_of(F.col("m")).alias("kind")).where("kind is not null")
    return kinds.select(F.explode(entities(F.col("kind"), F.col("m"))).alias("e")).select("e.kind", "e.value").distinct()


def _made(key: str, rows: DataFrame) -> DataFrame:
    """rows(kind, value, attempt) with ``made``, the value of an entity's surrogate: a value is itself a mention, or a name without its title."""
    k, v, a = F.col("kind"), F.col("value"), F.col("attempt")
    is_first, is_last = k.startswith("first_"), k.startswith("last")
    last = F.substring_index(v, "|", 1)

    def made(d: Column) -> Column:
        first = F.concat(last, F.lit("|"), F.lower(_word_surrogate(k, F.substring_index(v, "|", -1), d, a)))
        return F.when(is_first, first).when(is_last, F.lower(_word_surrogate(k, v, d, a))).otherwise(_from_digest(k, v, d, a))

    return rows.select("kind", "value", "attempt", _let(_digest(key, k, v, a), made).alias("made"))


def collided(df: DataFrame, text: str, key: str) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate another one has too, or that equals a value of the data: the attempt whose surrogate is distinct.

    Of those that share a surrogate the least keeps it, unless it is a value of the data; the others are hashed again. Names and e-mail
    addresses get longer with each attempt, so their room grows; numbers and secrets keep their format, whose room must exceed the
    number of distinct values. Runs on distinct values, and after the first round on collided ones.
    """
    rows = saved(_made(key, _entities(df, text).withColumn("attempt", F.lit(0))))
    originals = rows.where(~F.col("kind").startswith("first_")).select("kind", F.col("value").alias("made"))
    for _ in range(ROUNDS):
        order = F.struct("attempt", "value")
        first = saved(rows.groupBy("kind", "made").agg(F.min(order).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
        bad = rows.join(first, ["kind", "made"]).where(order != F.col("first")).select("kind", "value", "attempt")
        bad = saved(bad.union(rows.join(originals, ["kind", "made"], "left_semi").select("kind", "value", "attempt")).distinct())
        if bad.isEmpty():
            return rows.where("attempt > 0").select("kind", "value", "attempt")
        again = _made(key, bad.withColumn("attempt", F.col("attempt") + 1))
        rows = saved(rows.join(bad.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "made").union(again))
    raise RuntimeError("surrogates still collide: a format has no room for so many values")


def replace(df: DataFrame, text: str, key: str) -> DataFrame:
    """df with each mention of an entity in ``text`` replaced; the other columns and rows stay as they are.

    A mention's surrogate depends on the key, its type and its entities' values, so one entity has one surrogate
    throughout, in each mention's own format, script and case, and a key gives the same result again. Types are those of PATTERNS; a
    name is found by its title, and a name without one isn't. Distinct values get distinct surrogates, none of which is a value of the data
    (collided()); a first name's is distinct among those of its last name.

    Null texts stay null, texts without an entity stay byte for byte, repeated rows are
    treated alike. An empty table gives no rows. Names of df that begin with two underscores are reserved.
    """
    again = saved(collided(df, text, key))
    n = again.count()
    # one pass of the patterns marks mentions: every second part between marks is one
    mark = f"{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    parts = F.split(F.regexp_replace(F.col(text), f"({ANY})", f"{mark}$1{mark}"), mark, -1)
    suspect = F.col(text).rlike(SUSPECT)
    rows = df
    attempt_of = lambda kind, value: F.lit(0)
    if n:
        name = lambda kind, value: F.concat_ws("\u0001", kind, value)
        named = again.select(name("kind", "value").alias("name"), "attempt")
        if n <= BROADCAST_VALUES:
            rows = df.join(F.broadcast(named.agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__attempts"))))
        else:
            found = F.explode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
            mentions = df.where(suspect).select(F.sha2(F.col(text), 256).alias("__h"), found.alias("m")).withColumn("kind", kind_of(F.col("m"))).where("kind is not null")
            mentions = mentions.select("__h", F.explode(entities(F.col("kind"), F.col("m"))).alias("e")).select("__h", name("e.kind", "e.value").alias("name")).distinct()
            hit = saved(mentions.join(named, "name").groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__attempts")))
            rows = df.withColumn("__h", F.sha2(F.col(text), 256)).join(hit, "__h", "left").drop("__h")
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
        attempts = F.coalesce(F.col("__attempts"), none)
        attempt_of = lambda kind, value: F.coalesce(F.try_element_at(attempts, name(kind, value)), F.lit(0))

    def swapped(part: Column, i: Column) -> Column:
        mention = lambda kind: F.coalesce(surrogate(key, kind, part, attempt_of), part)
        return F.when(i % 2 == 1, _let(kind_of(part), mention)).otherwise(part)

    new = F.array_join(F.transform(parts, swapped), "")
    return rows.select(*[F.when(suspect, new).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns])


def query(spark, sf_dir):
    """op8: all documents with surrogates for personal data: doc_id, text."""
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", key_of(spark))
