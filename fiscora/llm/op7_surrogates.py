"""Personal data replaced by keyed surrogates, in DataFrame functions throughout.

Entities are found by one expression with an alternative for each kind; a name is found by its
title, and each of its words is an entity of its own. Words of a name that a document gives with a
title are names in the rest of that document as well, with or without one. Entities are known by
their canonical form (digits alone, small letters), so that one number in two spellings and "Dr
Anna Berg", "Mrs Anna Berg" and "Anna" stay the same. The distinct entities of the corpus make one
table. Each gets a surrogate from a keyed hash of its kind and canonical form: the same value gets
the same surrogate everywhere (coreference), letters stay letters of their script and case, digits
stay digits, separators stay; addresses stay addresses, numbers keep their country code and the
state of their check digits, names keep their script and, where titles tell it more often than not,
their gender. Where a surrogate is also a real entity of the corpus or that of another one, all but
the first are drawn again until all differ (distinctness); names and addresses grow by letters as
draws go on, so there is always room.

Values are replaced by cutting the text at its entities, joining each one with its surrogate, and
putting the pieces together in order. Texts without entities are not shuffled.

Defined results: a null text stays null; an empty one stays empty; equal texts get equal results;
rows with the same doc_id are told apart by their text; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import partitions, scratch, written

#: Draws after which names and addresses grow by a letter or syllable each time, and the most.
GROW, MOST = 4, 200
#: Titles by gender, and what each kind of entity looks like.
HIS = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Don", "господин", "г-н", "κύριος")
HER = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Doña", "госпожа", "г-жа", "κυρία")
ANY = ("Dr", "Prof")
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(HIS + HER + ANY) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])",
    "ssn": r"(?<![\p{L}0-9-])\d{3}-\d{2}-\d{4}(?![\p{L}0-9-])",
    "card": r"(?<![\p{L}0-9+])\d(?:[ -]?\d){12,18}(?![\p{L}0-9])",
    "phone": r"(?<![\p{L}0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}0-9])",
    "name": rf"(?<![\p{{L}}0-9]){_TITLE}\.? {_NAME}(?: {_NAME}){{0,2}}",
}
COMBINED = "|".join(f"(?:{p})" for p in KINDS.values())
#: The same, and any other word that begins with a capital letter.
EXTENDED = rf"{COMBINED}|(?<![\p{{L}}0-9]){_NAME}"
#: Letters of each script, in order, lower case.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
SYLLABLES = (
    ("ba be da do el fa ga he jo ka la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se so ta te ti to va ve vi wo".split(), "a", "n"),
    ("ва ве га да де жи ка ко ла ле ли ма ме ми на не ни но па ра ре ри ро са се та те ти".split(), "а", "н"),
    ("βα γε δα δο θε κα λα λε λι μα με μι να νε νι πα ρα ρε σα σε τα τε τι".split(), "α", "ος"),
)


def kind_of(value: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in [*KINDS.items()][:-1]:
        out = out.when(value.rlike(rf"^(?:{pattern})$"), kind)
    return out.otherwise("name")


def digits_sum(value: str) -> str:
    """SQL: the Luhn sum of a string of digits, the last one being the check digit."""
    return f"aggregate(sequence(1, length({value})), 0L, (s, i) -> s + CASE WHEN (length({value}) - i) % 2 = 0 THEN cast(substr({value}, i, 1) AS int) ELSE (2 * cast(substr({value}, i, 1) AS int)) DIV 10 + (2 * cast(substr({value}, i, 1) AS int)) % 10 END)"


def disguised(value: str, seed: str) -> str:
    """SQL: each letter and digit of value replaced by one of its kind, as seed says."""
    cases = "".join(
        f" WHEN instr('{a}', c) > 0 THEN substr('{a}', cast(1 + pmod(xxhash64({seed}, i), {len(a)}) AS int), 1) WHEN instr('{a.upper()}', c) > 0 THEN substr('{a.upper()}', cast(1 + pmod(xxhash64({seed}, i), {len(a)}) AS int), 1)"
        for a in ALPHABETS
    )
    return f"array_join(transform(sequence(1, length({value})), i -> element_at(transform(array(substr({value}, i, 1)), c -> CASE WHEN c BETWEEN '1' AND '9' THEN cast(1 + pmod(xxhash64({seed}, i), 9) AS string) WHEN c = '0' THEN cast(pmod(xxhash64({seed}, i), 10) AS string){cases} ELSE c END), 1)), '')"


#: SQL: the digits that the letters and digits of an IBAN stand for, modulo 97.
_MOD_97 = "aggregate(sequence(1, length({0})), 0L, (s, i) -> CASE WHEN substr({0}, i, 1) BETWEEN '0' AND '9' THEN (s * 10 + cast(substr({0}, i, 1) AS int)) % 97 ELSE (s * 100 + ascii(substr({0}, i, 1)) - 55) % 97 END)"
#: Country codes of telephone numbers, by their length.
_COUNTRY = r"^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\\d{3})"


def canonical(kind: Column, value: Column) -> Column:
    """What two spellings of one entity have in common."""
    number = F.regexp_replace(value, r"[^\p{L}0-9+]", "")
    return F.when(kind.isin("email", "name"), F.lower(value)).when(kind == "ip", value).otherwise(number)


def surrogate(key: str) -> Column:
    """From columns kind, value (canonical), gender, attempt: the same of another entity."""
    secret = hashlib.sha256(key.encode()).hexdigest()
    seed = f"sha2(concat_ws('|', '{secret}', kind, value, cast(attempt AS string)), 256)"
    more = f"greatest(attempt - {GROW}, 0)"
    # An address keeps its last label; the host is drawn from the host alone, so colleagues stay so.
    host, local = "substring_index(value, '@', -1)", "substring_index(value, '@', 1)"
    host_seed = f"sha2(concat_ws('|', '{secret}', 'host', {host}), 256)"
    stem = f"substr({host}, 1, length({host}) - length(substring_index({host}, '.', -1)))"
    grown = f"CASE WHEN {more} > 0 THEN {disguised(f"repeat('a', {more})", seed)} ELSE '' END"
    email = f"concat({disguised(local, seed)}, {grown}, '@', {disguised(stem, host_seed)}, substring_index({host}, '.', -1))"
    octet = lambda k: f"cast(1 + pmod(xxhash64({seed}, {k}), 254) AS string)"
    local_net = "CASE WHEN value LIKE '10.%' THEN '10' WHEN value LIKE '127.%' THEN '127' WHEN value LIKE '192.168.%' THEN '192.168' WHEN value LIKE '172.16.%' THEN '172.16' END"
    ip = f"CASE WHEN {local_net} IS NULL THEN concat_ws('.', {octet(1)}, {octet(2)}, {octet(3)}, {octet(4)}) WHEN instr({local_net}, '.') > 0 THEN concat_ws('.', {local_net}, {octet(3)}, {octet(4)}) ELSE concat_ws('.', {local_net}, {octet(2)}, {octet(3)}, {octet(4)}) END"
    # A card number keeps its first digit and whether its check digit is right.
    drawn = disguised("value", seed)
    body = f"concat(substr(value, 1, 1), substr({drawn}, 2, length(value) - 2))"
    card = f"concat({body}, cast(pmod({digits_sum('value')} - {digits_sum(f"concat({body}, '0')")}, 10) AS string))"
    phone = f"concat(regexp_extract(value, '{_COUNTRY}', 0), substr({drawn}, 1 + length(regexp_extract(value, '{_COUNTRY}', 0))))"
    # An IBAN's check digits are 98 less the remainder without them; wrong ones stay wrong.
    bban, land = f"substr({drawn}, 5)", "substr(value, 1, 2)"
    right = f"98 - {_MOD_97.format(f"concat({bban}, {land}, '00')")}"
    state = f"CASE WHEN {_MOD_97.format('concat(substr(value, 5), substr(value, 1, 4))')} = 1 THEN 0 ELSE 1 END"
    iban = f"concat({land}, lpad(cast({right} + {state} AS string), 2, '0'), {bban})"
    names = "CASE"
    for (parts, her, his), letters in zip(SYLLABLES, ALPHABETS, strict=True):
        listed = "array(" + ", ".join(f"'{p}'" for p in parts) + ")"
        word = f"concat_ws('', transform(sequence(1, 2 + {more} + cast(pmod(xxhash64({seed}, 0), 2) AS int)), i -> element_at({listed}, cast(1 + pmod(xxhash64({seed}, i), {len(parts)}) AS int))))"
        end = f"CASE gender WHEN 'f' THEN '{her}' WHEN 'm' THEN '{his}' ELSE '' END"
        own = "substr(value, 1, 1) <= 'ʯ'" if letters is ALPHABETS[0] else f"instr('{letters}', substr(value, 1, 1)) > 0"
        names += f" WHEN {own} THEN concat({word}, {end})"
    names += f" ELSE {drawn} END"
    return F.expr(f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'iban' THEN {iban} WHEN 'ssn' THEN {drawn} ELSE {names} END")


def written_as(value: str, new: str) -> Column:
    """SQL: new, a canonical form, in the spelling of value."""
    place = f"1 + length(regexp_replace(substr({value}, 1, i - 1), '[^\\\\p{{L}}0-9+]', ''))"
    number = f"array_join(transform(sequence(1, length({value})), i -> CASE WHEN substr({value}, i, 1) rlike '[\\\\p{{L}}0-9+]' THEN substr({new}, {place}, 1) ELSE substr({value}, i, 1) END), '')"
    cased = f"array_join(transform(sequence(1, length({new})), i -> CASE WHEN substr({value}, i, 1) <> lower(substr({value}, i, 1)) THEN upper(substr({new}, i, 1)) ELSE substr({new}, i, 1) END), '')"
    name = f"CASE WHEN length({value}) > 1 AND {value} = upper({value}) THEN upper({new}) ELSE initcap({new}) END"
    return F.expr(f"CASE kind WHEN 'email' THEN {cased} WHEN 'ip' THEN {new} WHEN 'name' THEN {name} ELSE {number} END")


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of entities (kind, value, gender): all surrogates differ, and none is
    an entity of the corpus."""
    open_, done = entities.withColumn("attempt", F.lit(0)), None
    values = entities.select(F.col("value").alias("real")).distinct()
    for _ in range(MOST):
        drawn = written(open_.withColumn("surrogate", surrogate(key)), "drawn")
        free = drawn.join(values, drawn["surrogate"] == values["real"], "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        firsts = free.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("w")).select("w.kind", "w.value", "surrogate")
        done = written(firsts if done is None else done.unionByName(firsts), "assigned")
        open_ = drawn.join(done.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return done
    raise ValueError("a format has no room for as many values as the corpus has")


def own_names() -> Column:
    """The words of the names that a text gives with a title, in small letters."""
    titled = F.regexp_extract_all("text", F.lit(KINDS["name"]), F.lit(0))
    words = F.flatten(F.transform(titled, lambda m: F.split(F.regexp_replace(m, rf"^{_TITLE}\.? ", ""), " ")))
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def pieces() -> Column:
    """All that may be an entity in a text; capitalised words only where the text names someone."""
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return F.when(F.size("own") > 0, every(EXTENDED)).otherwise(every(COMBINED))


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, t, i, kind, title, words): the entities of docs (doc_id, t, text, own), each with its
    place among the pieces of its text; a capitalised word that is no name here is none."""
    placed = docs.select("doc_id", "t", "own", F.posexplode(pieces()).alias("i", "match")).withColumn("plain", F.col("match").rlike(f"^{_NAME}$"))
    kept = placed.where(~F.col("plain") | F.array_contains("own", F.lower("match"))).drop("own").distinct()
    kind = F.when(F.col("plain"), "name").otherwise(kind_of(F.col("match")))
    kept = kept.withColumn("kind", kind).withColumn("title", F.when((F.col("kind") == "name") & ~F.col("plain"), F.regexp_extract("match", rf"^{_TITLE}\.? ", 0)).otherwise(""))
    words = F.when((F.col("kind") == "name") & ~F.col("plain"), F.split(F.expr("substr(match, length(title) + 1)"), " ")).otherwise(F.array("match"))
    return kept.select("doc_id", "t", "i", "kind", "title", words.alias("words"))


def genders(words: DataFrame) -> DataFrame:
    """(kind, value, gender) of the distinct entities: a name that stands before another word of a
    name has the gender of most of its titles."""
    plain = F.regexp_replace("title", r"\.? $", "")
    given = (F.col("kind") == "name") & (F.col("k") < F.col("n") - 1)
    count = lambda titles: F.sum((given & plain.isin(*titles)).cast("long"))
    both = words.groupBy("kind", "value").agg(count(HER).alias("her"), count(HIS).alias("his"))
    return both.select("kind", "value", F.when(F.col("her") > F.col("his"), "f").when(F.col("his") > F.col("her"), "m").otherwise("").alias("gender"))


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kinds array<string>) of every row: text with surrogates, drawn with a secret key."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    has = F.coalesce(F.col("text").rlike(COMBINED), F.lit(False))
    path = scratch(docs.sparkSession, "with-entities")
    # Dealt anew: expressions cost far more than the bytes that they are read from tell.
    docs.where(has).repartition(partitions(docs.sparkSession)).withColumns({"t": F.xxhash64("text"), "own": own_names()}).write.option("compression", "zstd").parquet(path)
    some = docs.sparkSession.read.parquet(path).repartition(partitions(docs.sparkSession))
    # Rows that are the same in id and text have the same result: one of them is looked up.
    words = found_in(some).select("doc_id", "t", "i", "title", "kind", F.size("words").alias("n"), F.posexplode("words").alias("k", "spelt"))
    words = written(words.withColumn("value", canonical(F.col("kind"), F.col("spelt"))), "entities")
    names = assigned(written(genders(words), "distinct"), key).withColumnRenamed("surrogate", "new")
    spelt = words.join(names, ["kind", "value"]).withColumn("new", written_as("spelt", "new"))
    joined = spelt.groupBy("doc_id", "t", "i").agg(F.first("title").alias("title"), F.first("kind").alias("found"), F.array_sort(F.collect_list(F.struct("k", "new"))).alias("parts"))
    told = joined.select("doc_id", "t", F.struct("i", "found", F.concat("title", F.array_join("parts.new", " ")).alias("new")).alias("e"))
    by_row = told.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list("e")).alias("es")).select(F.col("doc_id").alias("id2"), F.col("t").alias("t2"), "es")
    full = some.join(by_row, some["doc_id"].eqNullSafe(by_row["id2"]) & (some["t"] == by_row["t2"]))
    between = F.when(F.size("own") > 0, F.split("text", EXTENDED, -1)).otherwise(F.split("text", COMBINED, -1))
    cut = full.select("doc_id", "es", between.alias("between"), pieces().alias("matches"), F.map_from_entries(F.transform("es", lambda e: F.struct(e["i"], e["new"]))).alias("new"))
    put = F.expr("array_join(transform(between, (x, i) -> concat(x, coalesce(new[i], get(matches, i), ''))), '')")
    changed = cut.select("doc_id", put.alias("text"), F.col("es.found").alias("kinds"))
    return docs.where(~has).select("doc_id", "text", F.expr("cast(array() AS array<string>)").alias("kinds")).unionByName(changed)


def op7_surrogates(docs: DataFrame) -> DataFrame:
    """Each document's text with surrogates, and its numbers of entities. The key is the session's
    spark.fiscora.surrogates.key; without one, results can be drawn again by anyone (for tests)."""
    out = replace_personal_data(docs, docs.sparkSession.conf.get("spark.fiscora.surrogates.key", "not secret"))
    counts = [F.expr(f"cast(size(filter(kinds, x -> x = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("kinds").cast("long").alias("n_entities"), *counts, "text")
