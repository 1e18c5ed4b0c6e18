"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared lower-cased and trimmed. A repeated line stays at its
earliest place, by (doc_id, hash of the text, line number), nulls first. Lines
also repeat an earlier one within ``edits`` words replaced, added or left out,
if both have ``min_words`` words or more; with the defaults, one word in five.
Shorter lines repeat equal ones only. Words stand between single spaces.

Each line emits its variants: up to ``edits`` words each either left out or made
a wild card. Equal variants with ``s`` wild cards, made by leaving out ``d`` words
here and ``d'`` there, are within ``s + d + d'`` edits, and lines within a bound
have such variants in common; so equal keys are joined to the earliest line of
the key for each ``d'`` alone, no pairs are made within a group and no link is
lost. Keys are 128 bits: exclusive ors of hashes of words and their places, by
sums up to each place, so a variant takes constant time. Links are verified on
the words.

Within one edit, two lines share their first or their last half. Then only
lines that share a half with a different line emit variants; the others can
have no partner. What is joined by key is written first, so that a key that a
large share of lines has is split.

Defined results: blank lines aren't compared and stay, unless nothing else
does; a null text stays null and has no lines; rows that repeat both doc_id and
text are one document and get the same result; a null doc_id comes before all
others; further columns are carried along whatever their names; very long lines
are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.text import let
from attesta.session import materialise, release_shuffles, remove, scratch_dir

EDITS, MIN_WORDS = 1, 5
#: Words whose sums are made together.
_RUN = 16


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, dh, line_no, norm)`` of every line that isn't blank."""
    lines = docs.select("doc_id", "dh", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "dh", "line_no", F.lower(F.trim("line")).alias("norm")).where("norm <> ''")


def _ends(norm: str, n: str, min_words: int) -> list[Column]:
    """Hashes of the halves that a line shares with any other within one edit; null where not used.

    Of two lines with as many words one half agrees. If one has a word more,
    so do the halves as the shorter one is cut; hence both cuts of each line.
    """
    out = []
    for m in (n, f"({n} - 1)"):  # words of the shorter line
        long_enough = F.expr(f"{m} >= {min_words}")
        out.append(F.when(long_enough, F.xxhash64(F.lit(1), F.expr(m), F.expr(f"substring_index({norm}, ' ', cast({m} div 2 as int))"))))
        out.append(F.when(long_enough, F.xxhash64(F.lit(2), F.expr(m), F.expr(f"substring_index({norm}, ' ', cast({m} div 2 - {m} as int))"))))
    return out


def first_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each distinct line: its earliest place, its number of words, and the ends for comparison."""
    lines = _lines(docs)
    # Words stand between single spaces.
    n = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    ends = _ends("norm", "n", min_words)
    rows = lines.withColumn("n", n).select(
        F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(7), "norm").alias("k2"),
        F.struct("doc_id", "dh", "line_no", "n", *(e.alias(f"e{i}") for i, e in enumerate(ends))).alias("at"))
    return rows.groupBy("k1", "k2").agg(F.min("at").alias("at")).select("at.*")


def with_partners(firsts: DataFrame, path: str) -> DataFrame:
    """Places of distinct lines that share an end with another distinct line; ends that several have are written to ``path``."""
    ends = firsts.select("doc_id", "dh", "line_no", F.explode(F.array_compact(F.array("e0", "e1", "e2", "e3"))).alias("end"))
    shared = materialise(ends.groupBy("end").agg(F.count("*").alias("c")).where("c > 1").select("end"), path)
    return ends.join(shared, "end").select("doc_id", "dh", "line_no").distinct()


def _sums(xs: Column, names: list[str]) -> Column:
    """Exclusive or of the first 0, 1, ... n of an array of structs of longs, field by field; run by run."""
    both = lambda a, b: F.struct(*(a[f].bitwiseXOR(b[f]).alias(f) for f in names))
    nought = F.array(F.struct(*(F.lit(0).cast("long").alias(f) for f in names)))
    upto = lambda some: F.aggregate(some, nought, lambda acc, x: F.concat(acc, F.array(both(F.element_at(acc, -1), x))))

    def joined(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _RUN).cast("int")), lambda k: upto(F.slice(x, k * _RUN + 1, F.lit(_RUN))))
        return let(runs, lambda r: let(upto(F.transform(r, lambda a: F.element_at(a, -1))), lambda base: F.concat(
            F.flatten(F.transform(r, lambda a, k: let(F.get(base, k), lambda c: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v: both(v, c))))), F.array(F.element_at(base, -1)))))

    return let(xs, joined)


_HALVES = (1, 2)


def _name(half: int, t: int) -> str:
    return f"p{half}_{t}"


def _code(half: int, place: Column, word: Column) -> Column:
    return F.xxhash64(F.lit(half), place, word)


def _xor(first: Column, *more: Column) -> Column:
    for x in more:
        first = first.bitwiseXOR(x)
    return first


class _Sums:
    """Sums of a line's words up to each place; words count by their place less ``t``, the words left out before them.

    A state ``(i, s, a1, a2)`` is a beginning of a variant: the words before
    place ``i``, ``s`` of them wild cards, and both halves of their sum.
    """

    def __init__(self, sums: Column):
        self.p, self.n = sums, F.size(sums) - 1

    def at(self, half: int, t: int, i: Column) -> Column:
        return F.get(self.p, i)[_name(half, t)]

    def later(self, st: Column, f: Callable[[Column], Column]) -> Column:
        """Of each place that a further edit may have."""
        return F.transform(F.when(st["i"] < self.n, F.sequence(st["i"], self.n - 1)).otherwise(F.array().cast("array<int>")), f)

    def hidden(self, half: int, t: int, wild: bool, q: Column) -> list[Column]:
        return [_code(half, q - t, F.lit(0))] if wild else []

    def key(self, h: list[Column], s: Column, t: int) -> Column:
        return F.struct(h[0].alias("h1"), h[1].alias("h2"), s.cast("tinyint").alias("s"), F.lit(t).cast("tinyint").alias("d"))

    def state(self, i: Column, s: Column, a: list[Column]) -> Column:
        return F.struct(i.cast("int").alias("i"), s.cast("int").alias("s"), a[0].alias("a1"), a[1].alias("a2"))

    def as_they_are(self, states: Column, t: int) -> Column:
        """Keys of states without a further edit."""
        return F.transform(states, lambda st: self.key([_xor(st[f"a{k}"], self.at(k, t, st["i"]), self.at(k, t, self.n)) for k in _HALVES], st["s"], t))

    def last(self, states: Column, t: int, wild: bool) -> Column:
        """Keys with one edit more: a wild card at each later place, or each later word left out."""
        to = t if wild else t + 1

        def of(st: Column) -> Column:
            base = F.array(*(_xor(st[f"a{k}"], self.at(k, t, st["i"]), self.at(k, to, self.n)) for k in _HALVES))
            one = lambda x, q: self.key([_xor(F.get(x, k - 1), self.at(k, t, q), self.at(k, to, q + 1), *self.hidden(k, t, wild, q)) for k in _HALVES], st["s"] + int(wild), to)
            return let(base, lambda x: self.later(st, lambda q: one(x, q)))

        return F.flatten(F.transform(states, of))

    def more(self, states: Column, t: int, wild: bool) -> Column:
        """States with one edit more."""
        def of(st: Column) -> Column:
            one = lambda q: self.state(q + 1, st["s"] + int(wild), [_xor(st[f"a{k}"], self.at(k, t, q), self.at(k, t, st["i"]), *self.hidden(k, t, wild, q)) for k in _HALVES])
            return self.later(st, one)

        return F.flatten(F.transform(states, of))


def _keys(words: Column, edits: int) -> Column:
    """Keys of a line's variants: ``(h1, h2, s, d)`` with ``s`` wild cards and ``d`` words left out.

    What is used again and again is bound by :func:`let`, so that it is computed once.
    """
    shifts = range(edits + 1)
    placed = lambda codes: F.transform(codes, lambda c, j: F.struct(*(_code(k, j - t, c).alias(_name(k, t)) for t in shifts for k in _HALVES)))

    def variants(p: Column) -> Column:
        sums, out = _Sums(p), []
        states = {0: F.array(sums.state(F.lit(0), F.lit(0), [F.lit(0).cast("long")] * 2))}  # by the words left out
        for level in range(max(1, edits)):
            grown: dict[int, list[Column]] = {}
            for t, some in states.items():
                out.append(sums.as_they_are(some, t))
                for wild in (True, False) if edits else ():
                    if level == edits - 1:
                        out.append(sums.last(some, t, wild))
                    else:
                        grown.setdefault(t if wild else t + 1, []).append(sums.more(some, t, wild))
            states = {t: F.concat(*cs) for t, cs in grown.items()}
        return F.concat(*out)

    coded = F.transform(words, lambda x: F.xxhash64(x))
    return let(coded, lambda codes: let(_sums(placed(codes), [_name(k, t) for t in shifts for k in _HALVES]), variants))


def _variants(words: DataFrame, edits: int) -> DataFrame:
    """Keys of lines' variants, one a row: ``(ord, h1, h2, s, d)``. They are made before they become rows, so that a row carries no sums."""
    return words.select("ord", F.explode(_keys(F.col("w"), edits)).alias("v")).select("ord", "v.*")


def near_repeats(words: DataFrame, root: str, edits: int = EDITS) -> DataFrame:
    """Lines of ``words`` (``ord``, array ``w``) that are within ``edits`` words of an earlier one: their ``ord``.

    Keys, and the earliest lines of those that several have, are written below ``root``.
    """
    keys = materialise(_variants(words, edits), f"{root}/keys")
    first = [F.min(F.when(F.col("d") <= m, F.col("ord"))).alias(f"m{m}") for m in range(edits + 1)]
    earliest = materialise(keys.groupBy("h1", "h2").agg(F.count("*").alias("c"), *first).where("c > 1").drop("c"), f"{root}/earliest")
    release_shuffles(words.sparkSession)
    partner = F.get(F.array(*(f"m{m}" for m in range(edits + 1))), edits - F.col("s") - F.col("d"))
    links = keys.join(earliest, ["h1", "h2"]).withColumn("partner", partner).where(F.col("ord") > F.col("partner")).select("ord", "partner").distinct()
    pairs = links.join(words.select("ord", F.col("w").alias("a")), "ord").join(words.select(F.col("ord").alias("partner"), F.col("w").alias("b")), "partner")
    return pairs.where(within_edits("a", "b", edits)).select("ord").distinct()


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether two arrays of words differ by at most ``edits`` words replaced, added or left out."""
    if edits > 1:  # row by row of the distances between beginnings
        beside = lambda row, x: F.aggregate(
            F.sequence(F.lit(1), F.size(b)), F.array(F.get(row, 0) + 1),
            lambda new, j: F.concat(new, F.array(F.least(F.element_at(new, -1) + 1, F.get(row, j) + 1, F.get(row, j - 1) + (x != F.get(F.col(b), j - 1)).cast("int")))))
        return (F.abs(F.size(a) - F.size(b)) <= edits) & (F.element_at(F.aggregate(a, F.sequence(F.lit(0), F.size(b)), beside), -1) <= edits)
    na, nb = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z))
    longer, shorter = F.when(na > nb, F.col(a)).otherwise(F.col(b)), F.when(na > nb, F.col(b)).otherwise(F.col(a))
    # Words that agree from the front, and from the back; together they must cover the shorter one.
    front = lambda x, y: F.coalesce(F.nullif(F.array_position(F.transform(F.zip_with(x, y, lambda p, q: p == q), lambda e: F.coalesce(e, F.lit(False))), F.lit(False)), F.lit(0)) - 1, F.size(y))
    return F.when(na == nb, differ <= edits).when(F.abs(na - nb) <= edits, front(longer, shorter) + front(F.reverse(longer), F.reverse(shorter)) >= F.size(shorter)).otherwise(False)


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_words: int | None = None) -> DataFrame:
    """``(doc_id, text, kept_text, n_lines, n_removed)`` for every row of ``docs``.

    ``min_words`` is ``MIN_WORDS`` for each edit unless it is given; it must be
    more than ``edits``.
    """
    return _dedup(docs, edits, min_words).drop("others")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that stays; documents of which no line stays are dropped."""
    out = _dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    names = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    return out.select(*(names.get(c, F.col("others")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _dedup(docs: DataFrame, edits: int = EDITS, min_words: int | None = None) -> DataFrame:
    """As :func:`dedup_lines`, with a struct ``others`` of the further columns."""
    least = MIN_WORDS * edits if min_words is None else min_words
    if edits < 0 or least <= edits:
        raise ValueError("lines that are compared must have more words than may be edited")
    root = scratch_dir(docs.sparkSession)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("\0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others.alias("others"))
    texts = rows.withColumn("dh", F.xxhash64("text"))
    firsts = materialise(first_places(texts, least), f"{root}/firsts")
    release_shuffles(docs.sparkSession)
    partners = with_partners(firsts, f"{root}/ends") if edits == 1 else firsts.where(F.lit(edits > 0) & (F.col("n") >= least))
    some = partners.groupBy("doc_id", "dh").agg(F.collect_set("line_no").alias("nos"))
    once = texts.select("doc_id", "dh", "text").alias("t").join(some.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.dh") == F.col("s.dh"))).select("t.doc_id", "t.dh", "t.text", "s.nos")
    words = once.select("doc_id", "dh", F.split("text", "\n").alias("lines"), F.explode("nos").alias("no")).select(
        F.struct("doc_id", "dh", F.col("no").alias("line_no")).alias("ord"), F.split(F.lower(F.trim(F.get("lines", "no"))), " ").alias("w")).dropDuplicates(["ord"])
    # Places are numbered in their order, so that keys carry one number and its least is kept by hash.
    words = materialise(words.orderBy("ord").withColumn("id", F.monotonically_increasing_id()), f"{root}/words")
    release_shuffles(docs.sparkSession)
    near = near_repeats(words.select(F.col("id").alias("ord"), "w"), root, edits)
    gone = materialise(words.select("id", "ord").join(near.select(F.col("ord").alias("id")), "id", "left_semi"), f"{root}/gone").select("ord.*")
    for name in ("keys", "earliest", "words", "ends"):
        remove(docs.sparkSession, f"{root}/{name}")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.dh") == F.col(f"{b}.dh"))
    stay = firsts.alias("f").join(gone.alias("g"), same("f", "g") & (F.col("f.line_no") == F.col("g.line_no")), "left_anti")
    kept = materialise(stay.groupBy("doc_id", "dh").agg(F.collect_list("line_no").alias("kept")), f"{root}/kept")
    remove(docs.sparkSession, f"{root}/firsts")
    release_shuffles(docs.sparkSession)
    joined = texts.alias("t").join(kept.alias("k"), same("t", "k"), "left").select("t.doc_id", "t.text", "t.others", "k.kept")
    lines = F.split("text", "\n")
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    out = joined.withColumn("lines", lines).withColumn("places", F.when(F.col("kept").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(F.concat("kept", blank))))
    whole = F.col("text").isNull() | (F.size("places") == F.size("lines"))
    return out.select(
        "doc_id", "text", "others", F.when(whole, F.col("text")).otherwise(F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("places")).alias("n_removed"))
