"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; what is left is lower-cased
without punctuation. A text has two templates: one in which numbers and units
are placeholders, and one in which names are too. A name is a capitalised word
that isn't one of ``OPENERS``, or a run of such words between white space; a
unit is one of ``UNITS`` after a number.

Windows of ``WINDOW`` template words, those with ``LITERALS`` or more words that
are no placeholders, are hash-joined between items and documents. Documents
emit only windows that pass a bit table of the items'; the table has a fixed
greatest size, and nothing else is broadcast by this module. A document whose
matching windows could cover enough of an item is a candidate.

Candidates are verified on whole texts. An item leaks if matching windows cover
``THRESHOLD`` or more of its words: windows with equal slot values, wherever
they stand; or, within a stretch of a document at most twice as long as the
item (so words may be added or left out), windows whose slot values map one to
one. The mapping is the one that most slots agree on; windows at odds with it
don't count. Both are linear in the text.

Items whose template has fewer than three different words, or windows fewer
than half of which have ``LITERALS`` words, are looked for with equal values only,
by windows of the words as they are. Items of three or four words are one such
window; items of one or two leak only in a document that is nothing else.

Defined results: null or empty items and documents match nothing; benchmark
rows that repeat id and text count once, as do documents that repeat both; a
null doc_id or item_id is kept; several items in one document are all reported;
further columns of the inputs are not looked at; very long texts are looked at
whole; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import as_long, bound_batches
from attesta.llm.substrings import _P1, mix, rolling
from attesta.llm.tokens import forget
from attesta.session import materialise, scratch_dir

WINDOW, THRESHOLD, LITERALS = 5, 0.8, 2
#: Bits of the table that documents' windows are looked up in, as powers of two; items of a document verified at once.
LEAST_BITS, MOST_BITS, CHUNK = 18, 27, 64
#: Measures that become a placeholder after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent % degree degrees celsius fahrenheit hz khz mhz w kw watt watts v volt volts "
    "n newton newtons j joule joules mph kmh kph".split()
)
#: Words that are often capitalised, at the head of sentences, and aren't names.
OPENERS = frozenset(
    "a an the this that these those there here he she it they we you i his her its their our your my each every all both some any no one two three "
    "four five six seven eight nine ten many most several few if when while where what which who whose whom why how then now so and but or nor for "
    "from to of in on at by with without as after before during since until because although though under over between into about than not is are "
    "was were be been do does did has have had can could will would shall should may might must let find calculate compute determine show prove "
    "give given write solve suppose assume consider explain estimate evaluate simplify express use using".split()
)
NUM, NAME, UNIT = 1, 2, 3
#: Kinds of windows: words as they are, the two templates, and whole short documents.
EXACT, PLAIN, NAMED, WHOLE = 0, 1, 2, 3
#: Bytes of a text that are looked at together.
_SLAB = 1 << 20


def _classes() -> tuple[np.ndarray, ...]:
    code = np.arange(256)
    digit = (code >= 48) & (code <= 57)
    upper = (code >= 65) & (code <= 90)
    word = digit | upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    joins = np.isin(code, list(b".,:/"))
    value = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]  # A-Z count as a-z
    return digit, upper, word, joins, value


_DIGIT, _UPPER, _WORD, _JOINS, _VALUE = _classes()
_POWER, _INVERSE = _P1, np.uint64(pow(int(_P1), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_POWER, _SLAB + 1), _powers(_INVERSE, _SLAB + 1)


def _tokens(raw: bytes, base: int) -> tuple[np.ndarray, ...]:
    """Hash, bounds, and whether it is a number or capitalised, of each word of a slab."""
    b = np.frombuffer(raw, np.uint8)
    digit, word = _DIGIT[b], _WORD[b]
    if digit.any():
        word = word.copy()
        word[1:-1] |= _JOINS[b[1:-1]] & digit[:-2] & digit[2:]  # 3.5 is one number
    value = b
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    lo, hi = edges[::2], edges[1::2]
    accent = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)) + 1  # A-grave to Thorn count as lower case
    if len(accent):
        value = b.copy()
        value[accent] += 0x20
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[value] * _UP[: len(b)], out=sums[1:])
        hashes = mix((sums[hi] - sums[lo]) * _DOWN[lo]) | np.uint64(4)
    digits = np.concatenate([[0], np.cumsum(digit | (_JOINS[b] & word))]) if digit.any() else None
    number = digits[hi] - digits[lo] == hi - lo if digits is not None else np.zeros(len(lo), bool)
    capital = _UPPER[b[lo]]
    if len(accent):
        capital = capital.copy()
        capital |= np.isin(lo + 1, accent)
    return hashes, lo + base, hi + base, number, capital


OPENER_HASHES = np.sort(np.concatenate([_tokens(x.encode(), 0)[0] for x in sorted(OPENERS)]))
UNIT_HASHES = np.sort(np.concatenate([_tokens(x.encode(), 0)[0][:1] for x in sorted(UNITS) if x != "%"]))


class Template:
    """A text's words and its two templates: the hash of each word or placeholder, and the hash of its value."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + _SLAB)
            if end < len(raw):  # a slab ends at white space, unless a word is longer than half of one
                cut = max(raw.rfind(b" ", at + _SLAB // 2, end), raw.rfind(b"\n", at + _SLAB // 2, end))
                end = cut + 1 if cut >= 0 else end
            parts.append(_tokens(raw[at:end], at))
            at = end
        if not parts:
            parts = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0, bool),) * 2)]
        self.words, lo, hi, number, capital = (np.concatenate(x) for x in zip(*parts, strict=True))
        after = np.concatenate([[False], number[:-1]]) & ~number
        unit = np.zeros(len(self.words), bool)
        unit[after] = np.isin(self.words[after], UNIT_HASHES)
        self._plain = np.where(number, np.uint64(NUM), np.where(unit, np.uint64(UNIT), self.words))
        self._name = np.zeros(len(self.words), bool)
        some = np.flatnonzero(capital & (self._plain > UNIT))
        self._name[some] = ~np.isin(self.words[some], OPENER_HASHES)
        self._raw, self._lo, self._hi = raw, lo, hi

    def form(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """``(template, values)`` of a kind; in exact words there are no placeholders."""
        if kind == EXACT:
            return self.words, self.words
        if kind == PLAIN or not self._name.any():
            return self._plain, self.words
        name = self._name
        template, values = np.where(name, np.uint64(NAME), self._plain), self.words
        if (name[1:] & name[:-1]).any():  # names that only white space parts are one placeholder
            dark = np.concatenate([[0], np.cumsum(~np.isin(np.frombuffer(self._raw, np.uint8), list(b" \t\r\n")))])
            more = np.concatenate([[False], name[1:] & name[:-1] & (dark[self._lo[1:]] == dark[self._hi[:-1]])])
            at = np.flatnonzero(~more)
            place = np.arange(len(values)) - np.maximum.accumulate(np.where(more, 0, np.arange(len(values))))
            with np.errstate(over="ignore"):
                tagged = mix(values + place.astype(np.uint64) * _P1)
                values = np.add.reduceat(tagged, at)
            template = template[at]
        return template, values

    def named(self) -> bool:
        """Whether any word is a name."""
        return bool(self._name.any())


def windows(template: np.ndarray, kind: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, usable)`` of every window; those of templates need literal words."""
    grams = rolling(template, width, _P1)
    with np.errstate(over="ignore"):
        grams = mix(grams + np.uint64(kind * 8 + width) * _P1)
    if kind in (EXACT, WHOLE):
        return grams, np.ones(len(grams), bool)
    literal = np.concatenate([[0], np.cumsum(template > UNIT)])
    return grams, literal[width:] - literal[: max(0, len(literal) - width)] >= LITERALS


class Item:
    """A benchmark item: by kind, its template, values and windows."""

    def __init__(self, text: str | None, threshold: float = THRESHOLD):
        self.forms: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        t = Template(text)
        n = len(t.words)
        self.width = min(WINDOW, n)
        self.threshold = threshold
        if n >= WINDOW:
            for kind in (PLAIN, NAMED):
                if kind == NAMED and not t.named():
                    continue
                template, values = t.form(kind)
                grams, usable = windows(template, kind)
                if len(np.unique(template[template > UNIT])) > LITERALS and usable.sum() * 2 >= len(usable) > 0:
                    self.forms[kind] = template, values, grams, usable
        if n and PLAIN not in self.forms:
            kind = EXACT if n > 2 else WHOLE
            self.forms[kind] = t.words, t.words, *windows(t.words, kind, self.width)
        self.grams = {k: np.unique(g[u]) for k, (_, _, g, u) in self.forms.items()}
        self.size = {k: self.covered(u) for k, (_, _, _, u) in self.forms.items()}

    def covered(self, flags: np.ndarray) -> int:
        """Words that the flagged windows cover."""
        change = np.zeros(len(flags) + self.width, np.int64)
        change[: len(flags)] += flags
        change[self.width :] -= flags
        return int((np.cumsum(change) > 0).sum())

    def least(self, kind: int) -> int:
        """Covered words that make a leak."""
        return int(np.ceil(self.threshold * self.size[kind] - 1e-9))

    def leak(self, doc: Document) -> tuple[int, int, bool] | None:
        """``(words covered, words of the item, whether slots have other values)``; null if it doesn't leak."""
        found = [x for kind in self.forms if (x := self._leak(doc, kind))]
        return min(found, key=lambda x: (x[2], -x[0] / x[1])) if found else None

    def _leak(self, doc: Document, kind: int) -> tuple[int, int, bool] | None:
        _, values, grams, usable = self.forms[kind]
        own, least, size = self.grams[kind], self.least(kind), self.size[kind]
        order, theirs, valued = doc.sorted(kind, self.width)
        lo, hi = np.searchsorted(theirs, own, "left"), np.searchsorted(theirs, own, "right")
        at = np.flatnonzero(usable)
        gid = np.searchsorted(own, grams[at])
        flags = np.zeros(len(usable), bool)
        flags[at] = (hi > lo)[gid]
        if (n := self.covered(flags)) < least:
            return None
        if kind in (EXACT, WHOLE):
            return n, size, False
        same = with_values(grams, values, self.width)[at]
        flags[at] = valued[np.minimum(np.searchsorted(valued, same), len(valued) - 1)] == same  # some window was found
        n, whole = self.covered(flags), n
        equal = (n, size, False) if n >= least else None
        if n == whole:
            return equal
        # Stretches of the document, three items long and one apart, that have enough of the windows.
        long = len(values)
        spots = [order[a:b] for a, b in zip(lo, hi, strict=True)]
        p, g = np.concatenate(spots), np.repeat(np.arange(len(own)), hi - lo)
        places, inverse = np.unique(np.concatenate([p // long, p // long - 1, p // long - 2]), return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * len(own) + np.tile(g, 3))
        times = np.bincount(gid, minlength=len(own))
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // len(own), minlength=len(places)))])
        for k, place in enumerate(places.tolist()):
            here = pairs[ends[k] : ends[k + 1]] % len(own)
            if times[here].sum() * self.width < least:
                continue
            start = place * long
            n = self.covered(self._mapped(kind, at, gid, spots, start, start + 3 * long, doc.form(kind)[1]))
            if n >= least and (equal is None or n > equal[0]):
                return n, size, True
        return equal

    def _mapped(self, kind: int, at: np.ndarray, gid: np.ndarray, spots: list[np.ndarray], start: int, end: int, theirs: np.ndarray) -> np.ndarray:
        """Windows found in a stretch whose slots agree with the mapping that most slots agree on, as flags."""
        template, values, _, usable = self.forms[kind]
        here = [s[np.searchsorted(s, start) : np.searchsorted(s, end)] for s in spots]
        votes = Counter(int(here[g][0]) - i for i, g in zip(at.tolist(), gid.tolist(), strict=True) if len(here[g]) == 1)
        votes = votes or Counter(p - i for i, g in zip(at.tolist(), gid.tolist(), strict=True) for p in here[g][:1].tolist())
        shift = max(votes, key=lambda s: (votes[s], -s))
        steps = []
        for i, g in zip(at.tolist(), gid.tolist(), strict=True):
            if len(here[g]):
                k = int(np.searchsorted(here[g], i + shift))
                p = min(here[g][max(0, k - 1) : k + 1].tolist(), key=lambda x: abs(x - i - shift))
                shift = p - i
                steps.append((i, p))
        slots = {i: [i + o for o in range(WINDOW) if template[i + o] <= UNIT] for i, _ in steps}
        met = {(j, p + j - i) for i, p in steps for j in slots[i]}
        counts = Counter((int(template[j]), int(values[j]), int(theirs[q])) for j, q in met)
        there: dict = {}
        back: set = set()
        for (kind_, a, b), _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):  # the commonest first
            if (kind_, a) not in there and (kind_, b) not in back:
                there[kind_, a] = b
                back.add((kind_, b))
        flags = np.zeros(len(usable), bool)
        for i, p in steps:
            flags[i] = all(there.get((int(template[j]), int(values[j]))) == int(theirs[p + j - i]) for j in slots[i])
        return flags


def with_values(grams: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows together with the values of their slots."""
    with np.errstate(over="ignore"):
        return mix(grams + rolling(values, width, _P1) * _P1)


class Document:
    """A text that items are looked for in; what several items need is made once."""

    def __init__(self, text: str | None):
        self.template = Template(text)
        self._forms: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._sorted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def form(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self._forms:
            self._forms[kind] = self.template.form(kind if kind != WHOLE else EXACT)
        return self._forms[kind]

    def sorted(self, kind: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows by their hash (places ascending within one), the hashes, and the hashes with values."""
        if (kind, width) not in self._sorted:
            template, values = self.form(kind)
            if kind == WHOLE and len(template) != width:
                template = values = template[:0]
            grams = windows(template, kind, width)[0]
            order = np.argsort(grams, kind="stable")
            self._sorted[kind, width] = order, grams[order], np.sort(with_values(grams, values, width))
        return self._sorted[kind, width]


def leaks_of(text: str | None, items: list[tuple[int | None, Item]]) -> list[tuple[int | None, int, int, bool]]:
    """``(item_id, words covered, words of the item, whether slots have other values)`` of a text, each item tried."""
    doc = Document(text)
    return [(i, *found) for i, item in items if (found := item.leak(doc))]


def item_windows(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(ik, kind, width, least, gram, times)``: distinct windows of each item and how often they stand in it; ``items`` has ik and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = ["ik", "kind", "width", "least", "gram", "times"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for ik, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = Item(text, threshold)
                for kind, (_, _, grams, usable) in item.forms.items():
                    own, times = np.unique(grams[usable], return_counts=True)
                    for column, x in zip(out, (ik, kind, item.width, item.least(kind)), strict=False):
                        column.append(np.full(len(own), x, np.int64))
                    out[4].append(as_long(own))
                    out[5].append(times)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, kinds, strict=True)], names)

    return items.select("ik", "text").mapInArrow(run, "ik long, kind int, width int, least int, gram long, times int")


def bit_table(grams: DataFrame, n: int) -> np.ndarray:
    """Bits of windows by their first and by their last bits; at most ``2**MOST_BITS`` whatever ``n`` is."""
    size = int(np.clip(int(n * 32).bit_length(), LEAST_BITS, MOST_BITS))
    high, low = F.shiftrightunsigned("gram", 64 - size), F.col("gram").bitwiseAND(F.lit((1 << size) - 1))
    at = grams.select(F.explode(F.array(high, low)).alias("at"))
    one = F.expr("shiftleft(cast(1 as bigint), cast(at & 63 as int))")
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    table = np.zeros(1 << (size - 6), np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def maybe(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether windows may be in the table."""
    size = np.uint64(int(len(table)).bit_length() - 1 + 6)
    out = np.ones(len(grams), bool)
    for at in (grams >> (np.uint64(64) - size), grams & ((np.uint64(1) << size) - np.uint64(1))):
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def hits(docs: DataFrame, table: np.ndarray, shapes: list[tuple[int, int]]) -> DataFrame:
    """``(dk, th, gram)``: distinct windows of documents that may be items'; ``docs`` has dk, th, text."""
    shared = docs.sparkSession.sparkContext.broadcast((table, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table, shapes = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for dk, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = Document(text)
                for kind, width in shapes:
                    template = doc.form(kind)[0]
                    if kind == WHOLE and len(template) != width:
                        continue
                    grams, usable = windows(template, kind, width)
                    some = np.unique(grams[maybe(table, grams) & usable])
                    for column, x in zip(out, (np.full(len(some), dk), np.full(len(some), th), as_long(some)), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["dk", "th", "gram"])

    return docs.select("dk", "th", "text").mapInArrow(run, "dk long, th long, gram long")


def _known(docs: DataFrame) -> DataFrame:
    """Documents with two hashes of id and text by which they are told apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.xxhash64(F.lit(10), "text").alias("th"), "text")


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, dk, th, item_id, n_covered, n_words, reparameterised)``."""
    spark = docs.sparkSession
    bound_batches(spark)
    root = scratch_dir(spark)
    rows = _known(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = items.withColumn("ik", F.xxhash64("item_id", "text"))
    known = materialise(item_windows(items, threshold), f"{root}/windows")
    shapes = sorted((r["kind"], r["width"]) for r in known.select("kind", "width").distinct().collect())
    table = bit_table(known.select("gram"), known.count())
    met = hits(rows, table, shapes).join(known, "gram")
    enough = (F.sum("times") * F.first("width") >= F.first("least")).alias("enough")  # as many words as these windows could cover
    pairs = met.groupBy("dk", "th", "ik", "kind").agg(enough).where("enough").select("dk", "th", "ik").distinct()
    pairs = materialise(pairs, f"{root}/pairs")
    # A document's items are verified together, at most about CHUNK of them in a task's row.
    parts = pairs.groupBy("dk", "th").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    grouped = pairs.join(parts, ["dk", "th"]).withColumn("part", F.pmod(F.xxhash64("ik"), F.col("parts"))).join(items, "ik")
    # Written, so that its size is known when it meets the documents: a small one is broadcast, and they aren't shuffled.
    grouped = materialise(grouped.groupBy("dk", "th", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), f"{root}/grouped")
    held = rows.join(grouped, ["dk", "th"]).dropDuplicates(["dk", "th", "part"])
    names = ["doc_id", "dk", "th", "item_id", "n_covered", "n_words", "reparameterised"]
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, dk, th, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(i, dk, th, *x) for x in leaks_of(text, [(x["item_id"], Item(x["text"], threshold)) for x in some])]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return held.select("doc_id", "dk", "th", "text", "items").mapInArrow(run, "doc_id long, dk long, th long, item_id long, n_covered int, n_words int, reparameterised boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, n_covered, n_words, reparameterised)`` for every document and item that it leaks."""
    return _found(docs, benchmark, threshold).drop("dk", "th")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item. Documents are told apart by id and text, so one with a null id is judged by its text."""
    bad = _found(docs, benchmark, THRESHOLD).select(F.col("dk").alias("_dk"), F.col("th").alias("_th")).distinct()
    bad = materialise(bad, f"{scratch_dir(docs.sparkSession)}/bad")
    return docs.join(bad, (F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == bad["_dk"]) & (F.xxhash64(F.lit(10), docs["text"]) == bad["_th"]), "left_anti")
