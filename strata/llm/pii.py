"""Personal data: detected entities are replaced by keyed, type-consistent surrogates.

An entity is a type and a canonical form (e-mail addresses in lower case, the
last ten digits of a phone number, ...).  Its surrogate is drawn from a keyed
hash of both and an attempt number, so the same person or number gets the same
surrogate everywhere (coreference).  A surrogate keeps the format of each
occurrence: letters stay letters of the same case, digits digits, separators,
domain endings, country codes and prefixes stay; card numbers and IBANs keep
valid check digits, IP addresses stay addresses; personal names keep script
(Latin, Cyrillic, Greek), case and the gender that the form of address tells.

Persons are found by a form of address, then, in a second pass over the same
document, wherever their full name or surname stands alone.  Within a document a
surname that belongs to one full name means that person; the surrogate of a full
name has as many words, so that a mention by surname gets the surname's word.

Collision checks over the table of all different entities keep surrogates
distinct from one another and from every entity that really occurs: whoever
collides draws again (one entity per collision keeps its draw) until none is left.
Only those that collided are drawn and written again.  After every ``GROW`` failed
draws a surrogate becomes longer, so small spaces (one-digit forms, single names)
are never full; forms of fixed length have ``MOST_DRAWS`` draws, then it is an error.

Documents without entities are passed through untouched; only the others are
joined with their surrogates, selected by a bitmap of fixed size before the join;
the ``HOT`` most frequent entities are joined by a broadcast of that size.

Defined results: a null or empty text has no entities; rows equal in id and text
share their replacements; a string that is no valid card, address, IBAN or octet is
left alone, and a secret of signs only gets letters and digits; a name that is no
capitalised word is none; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path
from .common import flagged, folded, materialise, session_of, unfolded

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)?"
#: Forms of address and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m",
          "Señora": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Господин": "m", "Госпожа": "f",
          "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n"}
PATTERN = re.compile("|".join((
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b)",
    r"(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)",
    r"(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_.-]{6,128}))",
    r"(?P<hex>(?<![0-9A-Za-z])(?=[0-9a-f]{0,63}[a-f])(?=[a-f]{0,63}[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z]))",
    r"(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))",
    r"(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::"
    r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]))",
    r"(?P<ipv4>(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?\d))",
    r"(?P<card>(?<![\d-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![\d-]))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<phone>(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))",
    r"(?P<abroad>(?<![\w(])\+[1-9]\d{0,2}(?:[ .-]\(?\d{1,8}\)?){1,6}(?!\d))",
    r"(?P<person>\b(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? (?P<name>" + _NAME + "(?: " + _NAME + ")?))",
)))
#: Cheap test that a text can hold an entity at all.
_ANY = re.compile(r"[0-9@]|::|[=:]\s{0,3}[\"']?[A-Za-z0-9]|\b(?:" + "|".join(TITLES) + r")\b")
TYPES = ("email", "aws", "secret", "hex", "iban", "ipv6", "ipv4", "card", "ssn", "phone", "abroad", "person")
#: Digits of a phone number abroad, without its country code.
ABROAD_DIGITS = range(7, 15)
GROW, MOST_DRAWS = 16, 1000
#: Entities that are joined by broadcast: the most frequent ones.
HOT = 1000


def check_digit_valid(digits: str) -> bool:
    """Luhn: doubling every second digit from the right, the digit sum is a multiple of ten."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_valid(form: str) -> bool:
    """The number made of the letters (10 to 35) and digits, the first four moved behind, leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97 == 1


def _persons(text: str, titled: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int, str]]:
    """Titled mentions (start, stop, gender, name) with the canonical form they share in this document, and untitled ones."""
    genders, singles, families = {}, {}, {}  # of full names, of names of one word; full names by surname
    for _, _, gender, name in titled:
        low = name.lower()
        if " " in low:
            genders[low] = gender if genders.get(low, "n") == "n" else genders[low]
            families.setdefault(low.split(" ")[1], {})[low] = None
        elif gender != "n":
            singles.setdefault(low, []).append(gender)

    def meant(gender: str, low: str) -> str:
        """Canonical form of a mention: a surname is the one full name of its gender, if there is just one."""
        if " " in low:
            return f"{genders[low]}:{low}"
        if gender == "n" and len(set(singles.get(low, ()))) == 1:
            gender = singles[low][0]
        fits = [full for full in families.get(low, ()) if gender == genders[full] or "n" in (gender, genders[full])]
        return f"{genders[fits[0]]}:{fits[0]}" if len(fits) == 1 else f"{gender}:{low}"

    out, mentions = [], {}
    for start, stop, gender, name in titled:
        form = meant(gender, name.lower())
        out.append(("person", start, stop, form))
        mentions.setdefault(name, form)
    for _, _, gender, name in titled:
        if " " in name:
            mentions.setdefault(name.split(" ")[1], meant(gender, name.lower()))
    for name, form in list(mentions.items()):
        mentions.setdefault(name.upper(), form)
    known = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(mentions, key=len, reverse=True))) + r")(?!\w)")
    return out + [("person", m.start(), m.end(), mentions[m.group()]) for m in known.finditer(text)]


def detect(text: str | None) -> list[tuple[str, int, int, str]]:
    """Entities of a text, in order: (type, start, stop, canonical form)."""
    if not text or not _ANY.search(text):
        return []
    out, titled = [], []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup in TYPES else next(t for t in TYPES if m.group(t))
        start, stop = m.span({"secret": "value", "person": "name"}.get(kind, kind))
        form = text[start:stop]
        if kind == "card":
            form = re.sub(r"\D", "", form)
            if not check_digit_valid(form):
                continue
        elif kind == "iban":
            form = form.replace(" ", "")
            if not iban_valid(form):
                continue
        elif kind == "ipv6":
            try:
                form = ipaddress.IPv6Address(form).exploded
            except ValueError:
                continue
            if not int(form.replace(":", ""), 16) >> 16 or not re.search(r"\d", m.group()):
                continue  # the unspecified and loopback addresses, and words between colons
        elif kind == "phone":
            form = re.sub(r"\D", "", form)[-10:]
        elif kind == "abroad":
            country = re.match(r"\+\d+", form).end()
            form = re.sub(r"\D", "", form[country:])
            if len(form) not in ABROAD_DIGITS:
                continue
            kind, form = "phone", form[-10:]
        elif kind == "email":
            form = form.lower()
        elif kind == "person":
            words = form.split(" ")
            if not words[0][0].isupper():
                continue
            if len(words) > 1 and not words[1][0].isupper():
                stop -= len(words[1]) + 1
            titled.append((start, stop, TITLES[m.group("title")], text[start:stop]))
            continue
        out.append((kind, start, stop, form))
    if titled:
        out += _persons(text, titled)
    taken, at = [], 0
    for entity in sorted(out, key=lambda e: (e[1], -e[2])):  # titled mentions are found again in the second pass
        if entity[1] >= at:
            taken.append(entity)
            at = entity[2]
    return taken


class _Draw:
    """An endless keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{form}\0{attempt}".encode(), key=key[:64], digest_size=32).digest()
        self.block, self.bytes = 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes = hashlib.blake2b(self.seed + self.block.to_bytes(4, "little"), digest_size=64).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "little"), self.bytes[4:]
        return value % n

    def like(self, c: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        return chr(65 + self.below(26)) if "A" <= c <= "Z" else c


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LETTERS = _LOWER + _UPPER
#: Syllables and gender endings by script.
SYLLABLES = {"LATIN": "ba da el fi ga ha jo ka li mar ne or pe ra sa ti ul va wen zo".split(),
             "CYRILLIC": "ба ва га де жи за ка ли ма но пе ра со ти ул фе ха чи ша юр".split(),
             "GREEK": "αλ βα γε δη ζω θε κα λι μα νι ξε πα ρο σα τι φω χα ψη".split()}
ENDINGS = {("LATIN", "m"): "n", ("LATIN", "f"): "a", ("CYRILLIC", "m"): "н", ("CYRILLIC", "f"): "на",
           ("GREEK", "m"): "ς", ("GREEK", "f"): "η"}


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The replacement of a canonical form, itself in canonical form."""
    draw, longer = _Draw(key, kind, form, attempt), attempt // GROW

    def drawn(alphabet: str, n: int) -> str:
        return "".join(alphabet[draw.below(len(alphabet))] for _ in range(n))

    if kind == "email":
        name, _, domain = form.partition("@")
        host, _, top = domain.rpartition(".")
        return "".join(map(draw.like, name)) + drawn(_LOWER, longer) + "@" + "".join(map(draw.like, host)) + "." + top
    if kind == "aws":
        return form[:4] + drawn(_UPPER + _DIGITS, len(form) - 4)
    if kind == "hex" or kind == "secret" and re.fullmatch(r"(?=.*[a-f])[0-9a-f]+", form):
        return drawn("0123456789abcdef", len(form) + longer)
    if kind == "ipv4":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        groups = [f"{1 + draw.below(0xFFFF):04x}" if int(g, 16) else g for g in form.split(":")]
        return ":".join(groups)
    if kind == "card":
        digits = form[0] + "".join(map(draw.like, form[1:-1]))
        return next(digits + str(k) for k in range(10) if check_digit_valid(digits + str(k)))
    if kind == "iban":
        body = "".join(map(draw.like, form[4:]))
        return next(made for k in range(2, 99) if iban_valid(made := f"{form[:2]}{k:02}{body}"))
    if kind == "person":
        gender, _, name = form.partition(":")
        script = next((s for s in SYLLABLES if unicodedata.name(name[0], "").startswith(s)), "LATIN")
        parts = ["".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + draw.below(2) + longer))
                 for _ in name.split(" ")]
        return gender + ":" + " ".join([parts[0] + ENDINGS.get((script, gender), ""), *parts[1:]])
    if kind == "secret" and not any(c in _LETTERS or c in _DIGITS for c in form):
        return drawn(_LETTERS + _DIGITS, len(form) + longer)
    return "".join(map(draw.like, form)) + drawn(_DIGITS, longer)


def dressed(kind: str, occurrence: str, form: str, new: str) -> str:
    """The surrogate in the format of one occurrence: its separators, country code, case and words."""
    if kind == "person":
        words, real = new.partition(":")[2].split(" "), form.partition(":")[2].split(" ")
        said = occurrence.split(" ")
        if len(said) < len(words):  # mentioned by one of the words
            words = [words[real.index(said[0].lower())]]
        return " ".join(w.upper() if o.isupper() and len(o) > 1 else w.title() for o, w in zip(said, words))
    if kind == "ipv6":
        groups = [f"{int(g, 16):x}" for g in new.split(":")]
        made = ipaddress.IPv6Address(new).compressed if "::" in occurrence else ":".join(groups)
        return made.upper() if occurrence != occurrence.lower() else made
    if kind in ("phone", "card", "iban"):
        signs = re.compile(r"[0-9A-Z]" if kind == "iban" else r"\d")
        n = len(signs.findall(occurrence)) - len(form)
        rest, out = iter(new), []
        for c in occurrence:
            if signs.match(c):
                out.append(c if n > 0 else next(rest))
                n -= 1
            else:
                out.append(c)
        return "".join([*out, *rest])
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(occurrence, new)) + new[len(occurrence):]
    return new


def _entity_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Different entities of each document that has any: (keys..., type, form)."""
    for batch in batches:
        places, kinds, forms = [], [], []
        for k, text in enumerate(batch.column(0)):
            for kind, form in sorted({(e[0], e[3]) for e in detect(text.as_py())}):
                places.append(k)
                kinds.append(kind)
                forms.append(form)
        taken = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[1:]), pa.array(kinds, pa.string()),
                                          pa.array(forms, pa.string())], columns)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, form) of different entities with ``surrogate``: distinct, and never a form that occurs."""
    spark = session_of(entities)

    def draws(rows: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, r["type"], r["form"], r["attempt"]) for r in rows.to_pylist()], pa.string())

    draw = F.arrow_udf(draws, "string")(F.struct("type", "form", "attempt"))
    real = entities.select("type", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
    settled, attempt = scratch_path(spark, "surrogates"), 0
    schema = "type string, form string, surrogate string"
    spark.createDataFrame([], schema).write.parquet(settled)
    waiting = scratch_path(spark, "draws")
    entities.select("type", "form").write.parquet(waiting)
    while True:
        if attempt >= MOST_DRAWS:
            raise ValueError(f"no free surrogate after {MOST_DRAWS} draws")
        path = scratch_path(spark, "draws")
        spark.read.schema("type string, form string").parquet(waiting).withColumn("attempt", F.lit(attempt)).withColumn(
            "surrogate", draw).drop("attempt").write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        used = spark.read.schema(schema).parquet(settled).select("type", "surrogate", F.lit(True).alias("used"))
        turn = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("form"))
        judged = now.withColumn("turn", turn).join(real, ["type", "surrogate"], "left").join(used, ["type", "surrogate"], "left")
        again = F.col("real").isNotNull() | F.col("used").isNotNull() | (F.col("turn") > 1)
        marked = scratch_path(spark, "draws")
        judged.select("type", "form", "surrogate", again.alias("again")).write.parquet(marked)
        judged = spark.read.schema(schema + ", again boolean").parquet(marked)
        judged.where("NOT again").drop("again").write.mode("append").parquet(settled)
        following = scratch_path(spark, "draws")
        judged.where("again").select("type", "form").write.parquet(following)
        for done in (waiting, path, marked):
            drop_scratch(done)
        waiting, attempt = following, attempt + 1
        if spark.read.schema("type string, form string").parquet(waiting).isEmpty():
            return spark.read.schema(schema).parquet(settled)


def pseudonymise(docs: DataFrame, key: str | bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced in the text, and ``entities``: (type, start, stop) in the new text."""
    spark = session_of(docs)
    secret = key.encode() if isinstance(key, str) else key
    if not secret:
        raise ValueError("an empty key would let anyone recompute the surrogates")
    id_column, text_column = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    source = docs.select(text_column.alias("text"), id_column.alias("doc"), F.xxhash64(text_column).alias("text_hash"))
    kind = source.schema["doc"].dataType.simpleString()
    columns = ["doc", "text_hash", "type", "form"]
    found = materialise(spark, source.mapInArrow(lambda b: _entity_rows(b, columns),
                                                 f"doc {kind}, text_hash bigint, type string, form string"), "entities")
    counts = materialise(spark, found.groupBy("type", "form").agg(F.count(F.lit(1)).alias("n")), "different")
    surrogates = assign(counts.select("type", "form"), secret)
    # an entity of very many documents would be one key of the join: the most frequent ones are broadcast
    hot = counts.orderBy(F.desc("n"), "type", "form").limit(HOT).select("type", "form").join(surrogates, ["type", "form"])
    hot = F.broadcast(hot.withColumnRenamed("surrogate", "hot"))
    marked = found.distinct().join(hot, ["type", "form"], "left")
    rare = marked.where("hot IS NULL").drop("hot").join(surrogates, ["type", "form"])
    named = marked.where("hot IS NOT NULL").withColumnRenamed("hot", "surrogate").unionByName(rare)
    maps = (named.groupBy("doc", "text_hash")
            .agg(F.collect_list(F.struct("type", "form", "surrogate")).alias("_map"))
            .withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"}))
    columns_of = [c for c in docs.columns if c != "entities"]
    entry = pa.struct([("type", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def replace(rows: pa.Array) -> pa.Array:
        texts, spans = [], []
        for t, m in zip(rows.field("text"), rows.field("map")):
            value, known = t.as_py(), {(e["type"], e["form"]): e["surrogate"] for e in m.as_py() or []}
            parts, mine, at, length = [], [], 0, 0
            for what, start, stop, form in detect(value):
                new = dressed(what, value[start:stop], form, known[what, form])
                parts += [value[at:start], new]
                length += start - at + len(new)
                mine.append({"type": what, "start": length - len(new), "stop": length})
                at = stop
            texts.append(value if value is None else "".join([*parts, value[at:]]))
            spans.append(mine)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(entry))],
                                          ["text", "entities"])

    shape = "array<struct<type: string, start: int, stop: int>>"
    swap = F.arrow_udf(replace, f"struct<text: string, entities: {shape}>")
    rows = folded(docs, id=id_column, hash=F.xxhash64(text_column))
    marked = flagged(rows, F.col("hash"), found.select(F.col("text_hash").alias("id")), "some")
    clean = unfolded(marked.where(~F.col("some")), columns_of, entities=F.array().cast(shape))
    known = F.col("id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash"))
    joined = (marked.where(F.col("some")).join(maps, known, "left")
              .withColumn("new", swap(F.struct(F.col("all").getField(text).alias("text"), F.col("_map").alias("map")))))
    changed = unfolded(joined, columns_of, **{text: F.col("new.text"), "entities": F.col("new.entities")})
    return clean.union(changed)
