"""Personal information in running text and values: found, typed, and replaced in place.

Method: offset-preserving deobfuscation. A transducer rewrites the text to a plain form (homoglyphs and other scripts'
digits to ASCII, zero-width characters dropped, odd spaces to spaces, spelled digits to digits, ``(at)``/``dot``
disguises to ``@`` and ``.``) and keeps for each character of the plain form where it came from. Identifiers are
detected in the plain form; their spans are mapped back, so the placeholder replaces exactly the source characters and
the rest of the text stays as it was.

Names: a family name counts with a given name, an initial or an honorific before it, or a given name after a comma. What
is a given name and what looks like a family name is learned from all PERSON nodes (titles and aliases), at any size alike:
every word that is stated as a given name at least as often as as a family name, every word that is a family name at least
as often, and the first and last three and four letters of family names that two or more of them share: four at one end and
three at the other mark a family name. No name is left out and nothing is cut off by rank.

Scale: one linear pass, no shuffle of texts. The lexicon is made by aggregates and has a fixed size: both lists of names are
Bloom filters of BLOOM_BITS bits (no name is ever missed; of a million names one word in 100,000 passes by chance), and
beginnings and ends are bounded by four letters of an alphabet.

Defined cases: null and empty texts have nothing; long texts are searched whole; overlapping finds keep the longest of
the earliest kind; rows delivered twice give one row; contact_info that is no object is searched as text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.nicknames import SHORT_FORMS
from loomgraph.runtime import ship_package, write_stage

KINDS = ("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME")
LONG, SHORT = 4, 3
BLOOM_BITS, BLOOM_HASHES, BLOOM_SLICES = 1 << 26, 4, 16
# Titles before a family name, and letters of other alphabets that look like Latin ones.
HONORIFICS = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau mme mlle monsieur madame señor señora senor senora sr sra don doña".split())
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁӏАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "aeopcyxijshdlABEKMHOPCTYXIJSABEZHIKMNOPTYXoavpi", strict=True))
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_INVISIBLE = frozenset("​‌‍⁠﻿­᠎")

_DIGIT_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_DIGIT_WORD})(?:[\s,-]+(?:{_DIGIT_WORD}))+\b", re.I)
_DISGUISE = re.compile(r"(?i)\s*[\[({<]\s*at\s*[\])}>]\s*|\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*|(?<=[a-z0-9])\s+at\s+(?=[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+\b)|(?<=[a-z0-9])\s+(?:dot|punkt)\s+(?=[a-z0-9])")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|dot|punkt|point|punto)\s*[\])}>]")

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w[\w+-]*@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])")
_ID = re.compile(
    r"(?i)\b(?:ssn|social(?:\s+security)?(?:\s+(?:number|no\.?))?|sin)\b[\s:#]*\d{3}[-\s]?\d{2,3}[-\s]?\d{3,4}\b"
    r"|\b(?:passport|pasaporte|passeport|reisepass)\b[\s:#]*(?:(?:no|nr|number|num)\b\.?)?[\s:#]*[A-Z]{0,2}\d{6,9}\b"
    r"|\b(?:national\s+insurance|insurance)\s+(?:number|no\.?)[\s:#]*[A-Z]{0,2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?[A-Z]?\b"
    r"|\b(?:student|matriculation|matrikel)\s*-?(?:number|no\.?|id|nummer)[\s:#]*[A-Z]?\d{5,12}\b"
    r"|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|\bQQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
)
_PHONE = re.compile(
    r"(?<![\w.,#$€£+-])(?:"
    r"\+\d{1,3}[\s.-]?\(\d{2,4}\)[\s.-]?\d{3}[\s.-]?\d{4}"
    r"|\+\d{1,3}(?:[\s.-]\d{2,5}){2,4}"
    r"|\+\d{9,14}"
    r"|(?:1[\s.-])?\(\d{3}\)\s?\d{3}[\s.-]?\d{4}"
    r"|(?:1[\s.-])?[2-9]\d{2}([-.\s])\d{3}\1\d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}"
    r"|0\d(?:[\s.]\d{2}){4}"
    r")(?![\w-]|[.,]\d)"
)
_NOT_PHONE = re.compile(r"(?i)(?:\bisbn|\border|\bticket|\bbuild|\binvoice|\bversion|\bref(?:erence)?)\W{0,3}$")
_TYPE = r"(?:street|road|lane|avenue|ave|boulevard|blvd)"
_W = r"[^\W\d_][^\W\d_'’-]*"
_ADDRESS = re.compile(
    rf"(?i)(?<![\w$€£.,-])(?:(?:flat|apt|unit)\s+\d+,?\s+)?\d{{1,5}}[a-d]?,?\s+(?:rue|avenue|boulevard|calle|via)\s+(?:(?:de|du|des|la|le|del)\s+)*{_W}"
    rf"|(?<![\w$€£.,-])(?:(?:flat|apt|unit)\s+\d+,?\s+)?\d{{1,5}}[a-d]?\s+(?!(?:the|a|of|on|to|and|in|at|near|from)\b){_W}(?:\s+(?-i:[A-Z]{_W}))?\s+{_TYPE}\b\.?(?!\s+(?:parking|market))(?:,?\s+(?:apt|flat|unit)\.?\s+\d+)?"
    rf"|\b{_W}\s+{_TYPE}\s+\d{{1,4}}[a-d]?(?=\s*[,.;)\n]|\s*$|\s+(?!(?:minutes|people|pages|laps|days|members|names|times|percent)\b))(?![\d:%,]\d|[\d%])"
    rf"|\b{_W}(?:straße|strasse|weg|platz|gasse|allee)\s+\d{{1,4}}[a-d]?\b(?:,?\s+\d{{5}}\s+{_W})?"
)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


# Words without which a pattern above can't match: a text's set of words rules most patterns out.
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS_OF_ID = frozenset("ssn social sin passport pasaporte passeport reisepass insurance qq".split())
_STARTS_OF_ID = ("student", "matriculation", "matrikel")  # these may run on, as in 'StudentID'
_SIGNS_OF_STREET = frozenset("street road lane avenue ave boulevard blvd rue calle via".split())
_STREET_ENDS = ("straße", "strasse", "weg", "platz", "gasse", "allee")
_OTHER_CASES = ("ſ", "ı", "İ")  # letters that patterns take for s and i, but lower() doesn't
_PLAIN_ID = re.compile(r"\d{3}-\d{2}-\d{4}")
_SEVEN_DIGITS = re.compile(r"\d(?:[\s.()+-]{0,2}\d){6}")


class Bloom:
    """A set of words of a fixed size: what was put in is always in, another word hardly ever."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.known: dict[str, bool] = {}

    @staticmethod
    def places(word: str) -> list[int]:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "little")
        a, b = h & (2**64 - 1), (h >> 64) | 1
        return [(a + k * b) % BLOOM_BITS for k in range(BLOOM_HASHES)]

    def __contains__(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = all(self.bits[x >> 3] >> (x & 7) & 1 for x in self.places(word))
        return found

    def __ge__(self, words) -> bool:
        return all(w in self for w in words)

    def __getstate__(self) -> bytes:
        return pa.compress(self.bits.tobytes(), "zstd", asbytes=True)

    def __setstate__(self, state: bytes) -> None:
        self.__init__(np.frombuffer(pa.decompress(state, decompressed_size=BLOOM_BITS // 8, codec="zstd", asbytes=True), dtype=np.uint8))


def bloom_of(words: DataFrame) -> Bloom:
    """The filter of a column of words: bits are set in slices by each task and joined by slice."""
    width = BLOOM_BITS // 8 // BLOOM_SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = np.array([x for w in b.column(0).to_pylist() for x in Bloom.places(w)], dtype=np.int64)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if bits.any():
            slices = [pa.compress(s.tobytes(), "zstd", asbytes=True) for s in np.split(bits, BLOOM_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOOM_SLICES), pa.int32()), pa.array(slices, pa.binary())], names=["slice", "bits"])

    def join(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint8)
        for c in t.column("bits").to_pylist():
            total |= np.frombuffer(pa.decompress(c, decompressed_size=width, codec="zstd", asbytes=True), dtype=np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    out = np.zeros((BLOOM_SLICES, width), dtype=np.uint8)
    for r in words.mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(join, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(pa.decompress(r["bits"], decompressed_size=width, codec="zstd", asbytes=True), dtype=np.uint8)
    return Bloom(out.reshape(-1))


class Lexicon(NamedTuple):
    """Given names; beginnings and ends of family names, of LONG and SHORT letters; whole family names; beginnings of two
    to four letters of given names."""

    given: frozenset[str] | Bloom
    prefixes: frozenset[str]
    suffixes: frozenset[str]
    families: frozenset[str] | Bloom = frozenset()
    starts: frozenset[str] | None = None

    def begins_given(self, word: str) -> bool:
        """Whether a short form of two to four letters begins a given name."""
        return word in self.starts if self.starts is not None else any(g.startswith(word) for g in self.given)

    def family(self, word: str) -> bool:
        if word in self.families:
            return True
        if len(word) <= LONG:
            return False
        return (word[:LONG] in self.prefixes and word[-SHORT:] in self.suffixes) or (word[:SHORT] in self.prefixes and word[-LONG:] in self.suffixes)

    def family_word(self, word: str) -> bool:
        """family() of a word as written, remembered."""
        known = _FAMILY.get(word)
        if known is None:
            if len(_FAMILY) > 500_000 or _FAMILY.get("") is not self:
                _FAMILY.clear()
                _FAMILY[""] = self
            known = _FAMILY[word] = self.family(fold(word))
        return known


_FAMILY: dict[str, object] = {}


def fold(word: str) -> str:
    """Lower case without marks, letter by letter."""
    return word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def _odd(text: str) -> bool:
    return not text.isascii() and any(c in text for c in _OTHER_CASES)


def plain(text: str, gates: bool = True) -> tuple[str, list[tuple[int, int]] | None]:
    """The plain form, and for each of its characters the piece of ``text`` it stands for; None where both agree."""
    out, at = text, None
    if "\\" in text and text.lstrip("\ufeff \n\r\t").startswith("{"):
        # a JSON object as it was sent: its escapes stand for characters
        pieces, at, last = [], [], 0
        for m in _ESCAPE.finditer(text):
            pieces += [text[last : m.start()], chr(int(m[1], 16)) if m[1] else _ESCAPED.get(m[2], m[2])]
            at += [(i, i + 1) for i in range(last, m.start())]
            at.append(m.span())
            last = m.end()
        pieces.append(text[last:])
        at += [(i, i + 1) for i in range(last, len(text))]
        out = "".join(pieces)
    if not out.isascii():
        chars, places = [], []
        for i, c in enumerate(out):
            if c in _INVISIBLE:
                continue
            if ord(c) > 127:
                if c.isspace():
                    c = "\n" if c in "\u2028\u2029\x85" else " "
                elif c.isdigit():
                    c = str(unicodedata.digit(c))
                else:
                    c = HOMOGLYPHS.get(c, c)
                    if "！" <= c <= "～":
                        c = chr(ord(c) - 0xFEE0)
            chars.append(c)
            places.append((i, i + 1) if at is None else at[i])
        out, at = "".join(chars), places
    words = set(_LETTERS.findall(out.lower()))
    for pattern, rewrite in ((_SPELLED, _digits), (_DISGUISE, _sign)):
        if gates and (words.isdisjoint(DIGIT_WORDS) if pattern is _SPELLED else words.isdisjoint(("dot", "punkt")) and (words.isdisjoint(("at", "point", "punto")) or not _BRACKETED.search(out)) and not _odd(out)):
            continue
        pieces, places, last = [], [], 0
        for m in pattern.finditer(out):
            new = rewrite(m)
            if new is None:
                continue
            if at is None:
                at = [(i, i + 1) for i in range(len(out))]
            pieces += [out[last : m.start()], new]
            places += at[last : m.start()]
            places += [(at[m.start()][0], at[m.end() - 1][1])] * len(new)  # the whole run stands for each new character
            last = m.end()
        if pieces:
            pieces.append(out[last:])
            places += at[last:]
            out, at = "".join(pieces), places
    return out, at


def _digits(m: re.Match) -> str | None:
    """Six spelled digits or more as digits, ten of them grouped as a number is written."""
    words = re.findall(r"[a-z]+", m[0].lower())
    d = "".join(DIGIT_WORDS[w] for w in words)
    return None if len(d) < 6 else f"{d[:3]}-{d[3:6]}-{d[6:]}" if len(d) == 10 else d


def _sign(m: re.Match) -> str:
    return "@" if "at" in m[0].lower() else "."


def _names(text: str, lex: Lexicon) -> list[tuple[int, int]]:
    if not any(map(lex.family_word, set(_TOKEN.findall(text)))):
        return []
    tokens = [(m.start(), m.end(), fold(m[0])) for m in _TOKEN.finditer(text)]
    found = []
    for k, (s, e, w) in enumerate(tokens):
        if (w in lex.given and w not in lex.families) or not lex.family(w):
            continue
        start = None
        j, gap_end = k - 1, s
        while j >= 0 and j >= k - 3:
            ps, pe, pw = tokens[j]
            gap = text[pe:gap_end]
            if not re.fullmatch(r"\.?\s{1,4}|\.", gap):
                break
            if pw in HONORIFICS or pw in lex.given:
                start = ps
            elif gap.startswith(".") and 2 <= len(pw) <= 4 and text[ps].isupper() and lex.begins_given(pw):
                start = ps  # an abbreviated given name, with its full stop
            elif pe - ps == 1 and (gap.startswith(".") or (text[ps].isupper() and text[ps] not in "IA")):
                start = ps
            else:
                break
            j, gap_end = j - 1, ps
        end = e
        if start is None and k + 1 < len(tokens) and re.fullmatch(r",\s{1,4}|\s{1,4}", text[e : tokens[k + 1][0]]):
            ns, ne, nw = tokens[k + 1]
            comma = text[e] == ","
            if nw in lex.given and not lex.family(nw) and (comma or text[s].isupper()):
                # without a comma the name after it must not begin a name of its own
                after = tokens[k + 2][2] if k + 2 < len(tokens) and re.fullmatch(r"\.?\s{1,4}", text[ne : tokens[k + 2][0]]) else ""
                if not lex.family(after):
                    start, end = s, ne
        if start is not None:
            if found and start < found[-1][1]:  # a word that is either kind of name ends one and goes on in the next
                start = min(start, found.pop()[0])
            found.append((start, end))
    return found


def spans(text: str | None, lex: Lexicon, gates: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source text, in order and without overlap. ``gates`` only save time: without them every
    pattern is tried on every text, with the same result."""
    if not text:
        return []
    flat, at = plain(text, gates)
    hits: list[tuple[int, int, str]] = []
    work = flat

    def take(kind: str, found: list[tuple[int, int]]) -> None:
        nonlocal work
        for s, e in found:
            hits.append((s, e, kind))
            work = work[:s] + "\x01" * (e - s) + work[e:]

    if "@" in work:
        take("EMAIL", [m.span() for m in _EMAIL.finditer(work)])
    if any(c in work for c in "0123456789"):
        low = work.lower()
        words = set(_LETTERS.findall(low))
        every = not gates or _odd(work)
        if every or not words.isdisjoint(_SIGNS_OF_ID) or any(x in low for x in _STARTS_OF_ID) or _PLAIN_ID.search(work):
            take("ID_NUMBER", [m.span() for m in _ID.finditer(work)])
        if every or not words.isdisjoint(_SIGNS_OF_STREET) or any(e in low for e in _STREET_ENDS):
            take("ADDRESS", [m.span() for m in _ADDRESS.finditer(work)])
        if every or "+" in work or _SEVEN_DIGITS.search(work):
            take("PHONE", [m.span() for m in _PHONE.finditer(work) if not _NOT_PHONE.search(work[max(0, m.start() - 14) : m.start()])])
    take("NAME", _names(work, lex))
    hits.sort()
    return hits if at is None else [(at[s][0], at[e - 1][1], k) for s, e, k in hits if e > s]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for s, e, kind in found:
        out += [text[last:s], f"[{kind}]"]
        last = e
    return "".join(out) + text[last:]


def contact_values(raw: str) -> list[str]:
    try:
        doc = json.loads(raw)
    except ValueError:
        return [raw]

    def leaves(v: object) -> Iterator[str]:
        if isinstance(v, dict):
            for x in v.values():
                yield from leaves(x)
        elif isinstance(v, list):
            for x in v:
                yield from leaves(x)
        elif v is not None:
            yield str(v)

    return list(leaves(doc))


def name_lexicon(nodes: DataFrame) -> Lexicon:
    """Given names and the beginnings and ends of family names, from all PERSON nodes."""
    ship_package(nodes.sparkSession)
    aliases = F.get_json_object("properties", "$.aliases")
    listed = F.coalesce(F.from_json(aliases, "array<string>"), F.split(aliases, r"\s*;\s*"), F.array().cast("array<string>"))
    people = nodes.where((F.col("node_type") == "PERSON") & F.col("title").isNotNull())
    raw = people.select(F.explode(F.concat(F.array("title"), listed)).alias("name"))
    name = F.trim(F.regexp_replace(F.col("name"), r"(?i)^\s*(" + "|".join(sorted(HONORIFICS)) + r")\b\.?\s*", ""))
    parts = F.split(F.regexp_replace(name, r"\s+", " "), " ")
    comma = F.split(name, r"\s*,\s*")
    turned = F.size(comma) == 2
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}'’-]", ""))
    # a short form with a full stop, as 'The. Galdovik', is no given name by itself: in a text it counts with its stop only
    first = F.when(turned, F.split(comma[1], " ")[0]).otherwise(parts[0])
    names = raw.select(letters(F.when(~first.endswith("."), first)).alias("given"), letters(F.when(turned, comma[0]).when(F.size(parts) >= 2, F.element_at(parts, -1))).alias("family"))
    both = F.array(F.struct(F.lit("given").alias("role"), F.col("given").alias("word")), F.struct(F.lit("family").alias("role"), F.col("family").alias("word")))
    words = names.select(F.explode(both).alias("x")).select("x.*").where(F.length("word") >= 2).groupBy("word").agg(F.count_if(F.col("role") == "given").alias("n_given"), F.count_if(F.col("role") == "family").alias("n_family"))
    words = write_stage(words, "name-words").df
    given = words.where((F.col("n_given") > 0) & (F.col("n_given") >= F.col("n_family"))).select("word")
    whole = words.where((F.col("n_family") > 0) & (F.col("n_family") >= F.col("n_given"))).select(F.col("word").alias("family"))
    families = whole.where(F.length("family") > LONG)
    side = lambda s, n: F.struct(F.lit(s).alias("side"), (F.substring("family", 1, n) if s == "p" else F.substring("family", -n, n)).alias("part"))
    ends = families.select(F.explode(F.array(*(side(s, n) for s in "ps" for n in (LONG, SHORT)))).alias("x")).select("x.*").groupBy("side", "part").count().where("count >= 2").collect()
    starts = given.select(F.explode(F.array(*(F.substring("word", 1, n) for n in (2, 3, 4)))).alias("x")).distinct().collect()
    short = [fold(w) for w in SHORT_FORMS]
    every = given.unionByName(nodes.sparkSession.createDataFrame([(w,) for w in short], "word string"))
    return Lexicon(
        bloom_of(_folded(every, "word")),
        frozenset(fold(r["part"]) for r in ends if r["side"] == "p"),
        frozenset(fold(r["part"]) for r in ends if r["side"] == "s"),
        bloom_of(_folded(whole, "family")),
        frozenset(fold(r["x"]) for r in starts) | frozenset(w[:n] for w in short for n in (2, 3, 4)),
    )


def _folded(words: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(w) for w in b.column(0).to_pylist()], pa.string())], names=["word"])

    return words.select(column).mapInArrow(run, "word string")


def private_fields(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    of_captures = captures.select(F.lit("captures").alias("table_name"), F.col("id").alias("record_id"), F.lit("raw_content").alias("field_name"), F.col("raw_content").alias("text"))
    person = F.when(F.col("node_type") == "PERSON", F.get_json_object("properties", "$.contact_info"))
    fields = F.array(F.struct(F.lit("content").alias("field_name"), F.col("content").alias("text")), F.struct(F.lit("contact_info").alias("field_name"), person.alias("text")))
    of_nodes = nodes.select(F.lit("nodes").alias("table_name"), F.col("id").alias("record_id"), F.explode(fields).alias("x")).select("table_name", "record_id", "x.field_name", "x.text")
    return of_captures.unionByName(of_nodes).where("text is not null and text <> ''")


def find_personal(fields: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(table_name, record_id, field_name, pii_types, redacted) of the fields that hold any."""
    spark = fields.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            keep, types, texts = [], [], []
            for k, (field, text) in enumerate(zip(b.column("field_name").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if field == "contact_info":
                    kinds, new = set(), text
                    for v in contact_values(text):
                        found = spans(v, lex)
                        if found:
                            kinds |= {x[2] for x in found}
                            new = new.replace(json.dumps(v, ensure_ascii=False)[1:-1], redact(v, found)).replace(json.dumps(v)[1:-1], redact(v, found))
                else:
                    found = spans(text, lex)
                    kinds = {x[2] for x in found}
                    new = redact(text, found) if found else text
                if kinds:
                    keep.append(k)
                    types.append([x for x in KINDS if x in kinds])
                    texts.append(new)
            sel = b.select(["table_name", "record_id", "field_name"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*sel.columns, pa.array(types, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["table_name", "record_id", "field_name", "pii_types", "redacted"])

    return fields.select("table_name", "record_id", "field_name", "text").mapInArrow(run, "table_name string, record_id string, field_name string, pii_types array<string>, redacted string")
