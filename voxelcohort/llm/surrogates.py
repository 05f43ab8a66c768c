"""Personal data replaced by keyed surrogates of the same type, gender, script and format, with DataFrame functions only.

Every distinct entity of the corpus gets one surrogate, so repeated mentions stay mentions of one thing, and different
entities never share one: proposals that hit another proposal or a value found in the corpus are drawn again, round by
round, until none is left. Texts without entities pass unchanged and are never shuffled.

Defined results: null and empty texts pass unchanged with 0 entities; equal texts are rewritten alike; repeated rows
stay repeated; empty tables give empty results; other columns pass through (``n_entities`` is replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

# Patterns of the entity kinds, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Sir|господин)"
_FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа)"
_NAME = r"\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}\p{Ll}+){0,2}"
KINDS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?!\w)",
    "card": r"(?<!\w)\d{4}(?:[ \-]?\d{4}){3}(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\w)\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)",
    "secret": r"(?<=[\"'])[0-9A-Za-z_\-+/]{20,}={0,2}(?=[\"'])|(?<!\w)(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?!\w)",
    "male": rf"(?<!\p{{L}}){_MALE}\.? {_NAME}",
    "female": rf"(?<!\p{{L}}){_FEMALE}\.? {_NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# Texts that can hold an entity at all; a cheap test that spares most texts the full pattern.
MAYBE = rf"[0-9@]|(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}|[\"'][0-9A-Za-z_\-+/]{{20}}"
# Names to draw from, by gender and script (fixed values).
NAMES = {
    ("male", "latin"): "James Robert Thomas Daniel Martin Peter Simon Victor Oscar Hugo Felix Adam Lucas Bruno Emil Anton".split(),
    ("female", "latin"): "Anna Maria Clara Laura Julia Sofia Emma Nora Elena Irene Alice Helena Marta Paula Rosa Vera".split(),
    ("family", "latin"): "Miller Walker Turner Weber Keller Becker Moreau Lambert Garnier Molina Vargas Ortega Novak Larsen Bennett Foster".split(),
    ("male", "cyrillic"): "Иван Пётр Сергей Андрей Никита Максим Олег Павел".split(),
    ("female", "cyrillic"): "Анна Мария Ольга Елена Ирина Дарья Вера Нина".split(),
    ("family", "cyrillic"): "Орлов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев".split(),
}


def _kind(value: Column) -> Column:
    """The first kind whose pattern covers the whole value; quoted secrets lost their quotes to the look-around."""
    cases = F.when(F.contains(value, F.lit("@")), F.lit("email"))
    for kind in ("male", "female"):
        cases = cases.when(value.rlike(rf"^(?:{KINDS[kind]})$"), F.lit(kind))
    for kind in ("ip", "iban", "card", "ssn", "phone"):
        cases = cases.when(value.rlike(rf"^(?:{KINDS[kind]})$"), F.lit(kind))
    return cases.otherwise(F.lit("secret"))


def _lead(kind: Column, value: Column) -> Column:
    """The form of address, which stays; empty for other kinds."""
    return F.when(kind.isin("male", "female"), F.regexp_extract(value, r"^(\S+ )", 1)).otherwise(F.lit(""))


def _noise(seed: Column) -> Column:
    """512 hexadecimal digits that follow from the seed."""
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(8)])


def _byte(noise: Column, i: Column) -> Column:
    return F.conv(F.substring(noise, (i % 128) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _same_shape(value: Column, noise: Column, start: Column | int = 0) -> Column:
    """Digits, small and capital letters replaced by others of their kind from character ``start`` on."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    draw = lambda among, i: F.substring(F.lit(among), _byte(noise, i) % len(among) + 1, F.lit(1))

    def other(c: Column, i: Column) -> Column:
        return (
            F.when(i < start, c).when(c.rlike(r"^\d$"), draw("0123456789", i))
            .when(c.rlike("^[a-z]$"), draw(letters, i)).when(c.rlike("^[A-Z]$"), draw(letters.upper(), i)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _hex_shape(value: Column, noise: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), _byte(noise, i) % 16 + 1, F.lit(1))), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    number = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(number, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, noise: Column) -> Column:
    """Same grouping; the last digit makes the number pass the Luhn test exactly if the original passes."""
    drawn = _same_shape(value, noise)
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    sum0 = _luhn(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0")))
    sound = _luhn(F.regexp_replace(value, r"\D", "")) == 0
    return F.concat(head, ((20 - sum0 + F.when(sound, 0).otherwise(1 + _byte(noise, F.lit(100)) % 9)) % 10).cast("string"))


def _ip(value: Column, noise: Column) -> Column:
    part = F.split(value, r"\.")
    private = value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    octet = lambda k: (1 + _byte(noise, F.lit(k)) % 254).cast("string")
    first = F.when(private, part[0]).otherwise((1 + F.pmod(_byte(noise, F.lit(0)), F.lit(223))).cast("string"))
    return F.concat_ws(".", first, F.when(private & ~value.rlike("^(?:10|127)"), part[1]).otherwise(octet(1)), octet(2), octet(3))


def _email(value: Column, noise: Column) -> Column:
    """Name and host labels redrawn; the last label, and "example" before it, stay."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    kept = F.regexp_extract(host, r"((?:^|\.)(?i:example)\.[^.]+|\.[^.]+)$", 1)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(kept))
    return F.concat(_same_shape(local, noise), F.lit("@"), _same_shape(front, F.reverse(noise)), kept)


def _name(kind: str, value: Column, noise: Column, attempt: Column) -> Column:
    """A given name of the gender (if there was one) and a family name, in the script of the original; later attempts add
    family names, so that any number of different people stay different."""

    def drawn(script: str) -> Column:
        given, family = (F.array(*[F.lit(x) for x in NAMES[who, script]]) for who in (kind, "family"))
        pick = lambda among, i, n: F.element_at(among, _byte(noise, F.lit(i)) % n + 1)
        n_given, n_family = len(NAMES[kind, script]), len(NAMES["family", script])
        families = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1) + attempt), lambda i: F.element_at(family, _byte(noise, i) % n_family + 1)), "-")
        both = F.concat_ws(" ", pick(given, 0, n_given), families)
        return F.when(F.contains(value, F.lit(" ")), both).otherwise(families)

    return F.when(value.rlike(r"^\p{IsCyrillic}"), drawn("cyrillic")).otherwise(drawn("latin"))


def proposal(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The surrogate that the key, the entity and the attempt determine."""
    noise = _noise(F.concat_ws("|", F.lit(secret), kind, value, attempt.cast("string")))
    prefix = F.length(F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .\-(])|)", 1))
    return (
        F.when(kind == "email", _email(value, noise)).when(kind == "ip", _ip(value, noise)).when(kind == "card", _card(value, noise))
        .when(kind == "phone", _same_shape(value, noise, prefix)).when(kind == "iban", _same_shape(value, noise, 2))
        .when(kind == "male", _name("male", value, noise, attempt)).when(kind == "female", _name("female", value, noise, attempt))
        .when(value.rlike("^[0-9a-f]+$"), _hex_shape(value, noise)).when(value.rlike("^[0-9A-F]+$"), F.upper(_hex_shape(value, noise)))
        .otherwise(_same_shape(value, noise))
    )


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) with one surrogate per entity, none of them shared and none equal to a corpus value.

    Each round the smallest value keeps a contested proposal; the others, and proposals equal to a value of the corpus or
    to a surrogate already given, try again. Every round is cut into the shared folder.
    """
    known = entities.select(F.col("value").alias("surrogate"))
    pending = entities.withColumn("attempt", F.lit(0))
    given: list[DataFrame] = []
    while True:
        drawn = pending.withColumn("surrogate", proposal(F.col("kind"), F.col("value"), F.col("attempt"), secret))
        taken = reduce(DataFrame.unionByName, [known, *[g.select("surrogate") for g in given]])
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("first")).join(taken, "surrogate", "left_anti")
        won = first.select("surrogate", F.col("first.value").alias("value"), F.col("first.kind").alias("kind"))
        given.append(cut_lineage(won))
        pending = cut_lineage(pending.join(given[-1].select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, given)


def replace(docs: DataFrame, secret: str, text: str = "text", counted: str | None = "n_entities") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and their number in ``counted`` (None: no such column)."""
    columns = [c for c in docs.columns if c != counted]
    none = F.array().cast("array<string>")
    # the row travels as one struct, so that no column of it can clash with a helper column
    found = docs.select(F.struct(*[docs[c] for c in columns]).alias("row")).withColumn("text", F.col("row")[text].cast("string"))
    found = found.withColumn("found", F.coalesce(F.when(
        F.col("text").rlike(MAYBE), F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))), none))
    clean, private = found.filter(F.size("found") == 0), found.filter(F.size("found") > 0)
    # what is replaced follows from the text alone, so equal texts share one row here and need no row id
    texts = cut_lineage(private.select(F.sha2("text", 256).alias("hash"), "found").groupBy("hash").agg(F.min("found").alias("found")))
    mentions = texts.select("hash", F.posexplode("found").alias("at", "mention")).withColumn("kind", _kind(F.col("mention")))
    mentions = mentions.withColumn("lead", _lead(F.col("kind"), F.col("mention")))
    mentions = mentions.withColumn("value", F.substring(F.col("mention"), F.length("lead") + 1, F.length("mention")))
    table = assign(cut_lineage(mentions.select("kind", "value").distinct()), secret)
    named = mentions.join(table, ["kind", "value"]).select("hash", F.struct("at", F.concat("lead", "surrogate").alias("new")).alias("one"))
    new = named.groupBy("hash").agg(F.array_sort(F.collect_list("one")).alias("new"))
    rebuilt = F.array_join(F.zip_with(F.split("text", PATTERN, -1), F.col("new.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = private.withColumn("hash", F.sha2("text", 256)).join(new, "hash").withColumn("text", rebuilt)
    result = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns]
    result += [F.size("found").alias(counted)] if counted else []
    return clean.select(*result).unionByName(changed.select(*result))
