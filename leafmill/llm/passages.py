"""Passages that repeat word for word, wherever they begin and end.

A word that lies in `least` consecutive words that stand earlier, in a document before or further up in the
same one, is cut. Two steps find them all, with DataFrame functions only. First, the places of a text's fingerprints are
chosen by what stands there: words whose hash, with that of the next, is divisible by `_RATE`, and, where none is among the next
`least` - `gram` + 1 words, every word. Whether a word is one depends on no word further on than these, so two places of
`least` equal words have the same fingerprints, one at least, each the hash of `gram` words. Then, of the documents with a fingerprint that
repeats, the runs of `least` words whose fingerprints all repeat are hashed, and each that isn't the first place of its hash is cut.

Nothing is laid beside anything else: rows are places, and their number grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import saved

WHITE = " \t\r\x0b\f"
KEY = ["doc_id", "hash"]
_CUT = "array<struct<b: int, e: int>>"
#: One word of ten is a place of a fingerprint: one whose pairs() is below this.
_LOW = -(1 << 63) + (1 << 64) // 10


def same(a: str, b: str) -> Column:
    """Whether both sides are one document."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash"))


def copied() -> Column:
    """Whether a row's text has a holder before its doc_id, of the columns holder and shared, null without one."""
    return F.coalesce("shared", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("holder"))


def repeated(chosen: DataFrame, name: str) -> DataFrame:
    """Of fingerprints (doc_id, hash, f, n), once for a document: (doc_id, hash, fs) with those that repeat."""
    marks = saved(chosen, f"{name}-fingerprints")
    often = marks.groupBy("f").agg(F.sum("n").alias("n")).where("n > 1").select("f")
    return saved(marks.join(often, "f", "left_semi").groupBy(*KEY).agg(F.collect_set("f").alias("fs")), f"{name}-places")


def merged(runs: DataFrame, rest: list[str]) -> DataFrame:
    """Of runs (doc_id, hash, r, b, e), r their hash: (doc_id, hash, cuts), all but the first place of each
    joined into ranges (b, e) that neither touch nor overlap. Columns of `rest` are a document's own.

    Rows that repeat doc_id and hash are one document, and one place.
    """
    place = F.rank().over(Window.partitionBy("r").orderBy(*KEY, "b"))
    own = [F.first(c).alias(c) for c in rest]
    later = runs.where("r is not null").withColumn("place", place).where("place > 1").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("at"), *own)
    zero = f"named_struct('runs', cast(array() as {_CUT}), 'b', 0, 'e', -2)"
    close = "if(a.e < 0, a.runs, array_append(a.runs, named_struct('b', a.b, 'e', a.e)))"
    step = f"(a, x) -> if(a.e >= 0 and x.b <= a.e + 1, named_struct('runs', a.runs, 'b', a.b, 'e', greatest(a.e, x.e)), named_struct('runs', {close}, 'b', x.b, 'e', x.e))"
    return later.select(*KEY, F.expr(f"aggregate(at, {zero}, {step}, a -> {close})").alias("cuts"), *rest)


_OWN = r"[ \t\r\x0B\f]*"
#: Of a line and its break: a word with the white space around it, the last one with the break; a blank line is one.
#: The kinds of characters are apart, so nothing that matched is ever given back.
_WORD_AND_SPACE = rf"{_OWN}+[^ \t\r\x0B\f\n]++{_OWN}+\n?|{_OWN}+\n"


def _bound(x: Column, use) -> Column:
    """use(x), with x made once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _between(cuts: Column, k: Column, n: Column) -> tuple[Column, Column]:
    """Where the stretch before cut k begins and ends, that behind the last one for k = size(cuts)."""
    return F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)["e"] + 1), F.when(k == F.size(cuts), n).otherwise(F.get(cuts, k)["b"])


def left_over(text: Column, lines: Column, words: Column) -> Column:
    """The lines of a text, each with a line break, without the lines and words that are cut: arrays of (b, e) of their
    numbers, in order and apart. A blank line counts as a word; of a line whose end is cut, but not its
    beginning, the break stays. All is put together from slices, in time in proportion to the text."""

    def tokens(ls: Column) -> Column:
        """The words of all lines; those of lines that are cut are empty."""

        def stretch(k: Column) -> Column:
            j = F.floor(k / 2).cast("int")
            begin, end = _between(lines, j, F.size(ls))
            gone = k % 2 == 1
            cut = F.get(lines, j)
            first, after = F.when(gone, cut["b"]).otherwise(begin), F.when(gone, cut["e"] + 1).otherwise(end)
            own = F.slice(ls, first + 1, F.greatest(after - first, F.lit(0)))
            found = lambda x: F.regexp_extract_all(F.concat(x, F.lit("\n")), F.lit(_WORD_AND_SPACE), F.lit(0))
            return F.transform(own, lambda x: F.when(gone, F.transform(found(x), lambda _: F.lit(""))).otherwise(found(x)))

        return F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) * 2), stretch)))

    def kept(t: Column) -> Column:
        def stretch(k: Column) -> Column:
            begin, end = _between(words, k, F.size(t))
            cut, before = F.get(words, k - 1), F.get(t, F.get(words, k - 1)["b"] - 1)
            inside = F.slice(t, cut["b"] + 1, cut["e"] - cut["b"] + 1)
            torn = (k > 0) & (cut["b"] > 0) & (before != "") & ~F.endswith(before, F.lit("\n")) & F.exists(inside, lambda x: F.endswith(x, F.lit("\n")))
            return F.concat(F.array(F.when(torn, F.lit("\n")).otherwise("")), F.slice(t, begin + 1, F.greatest(end - begin, F.lit(0))))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(words)), stretch)), "")

    return _bound(_bound(F.split(text, "\n"), tokens), kept)


def _split(text: Column) -> Column:
    """The words of a text."""
    odd = F.lit(False)
    for c in WHITE[1:]:
        odd = odd | F.contains(text, F.lit(c))
    # a pattern, or a table of characters, takes longer than one replacement, and few texts need it
    plain = F.when(odd, F.translate(text, WHITE[1:] + "\n", " " * len(WHITE))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def _hashes(text: Column) -> Column:
    """The hashes of a text's words."""
    return F.transform(_split(text), lambda x: F.xxhash64(x))


def _clear(marks: Column, n: Column, width: int) -> Column:
    """Where `width` places of n begin that hold none of the marks, which are in order."""

    def between(bounds: Column) -> Column:
        wide = F.filter(F.transform(bounds, lambda x, i: F.struct(x.alias("a"), F.get(bounds, i + 1).alias("b"))), lambda x: x["b"] - x["a"] > width)
        return F.flatten(F.transform(wide, lambda x: F.sequence(x["a"] + 1, x["b"] - width)))

    return _bound(F.concat(F.array(F.lit(-1)), marks, F.array(n)), between)


def _pairs(w: Column) -> Column:
    """Of each word hash, that with the next; words alone are too unlike in number. The last is null."""
    return F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a.bitwiseXOR(b))


def _places(c: Column, reach: int, gram: int) -> Column:
    """The places of fingerprints among words of which c are the pairs."""
    chosen = F.array_compact(F.transform(c, lambda x, k: F.when(x < _LOW, k)))
    every = _bound(chosen, lambda at: F.concat(at, _clear(at, F.size(c), reach)))
    return F.filter(every, lambda k: k <= F.size(c) - gram)


def _is_place(least: int, reach: int, gram: int) -> str:
    """SQL for the same of a row: whether word k, whose pair is x, is a place. The first few words tell mostly, so the
    others are looked at last; there is no lambda, as lambdas aren't compiled, and no condition of c alone, for which Spark
    would make c a second time, before its rows."""
    parts = [(a, min(a, reach - a)) for a in (8 << i for i in range(10)) if a < reach]
    clear = " and ".join(f"coalesce(array_min(slice(c, k + 1 + {a}, {n})) >= {_LOW}L, true)" for a, n in [(0, min(8, reach)), *parts])
    return f"k <= if(size(c) >= {least}, size(c) - {gram}, -1) and (x < {_LOW}L or k <= size(c) - {reach} and {clear})"


def _numbers(text: Column) -> Column:
    """The number of each word of a text in which a blank line counts as a word."""

    def lines(text: Column) -> Column:
        words = lambda x: F.when(F.btrim(x, F.lit(WHITE)) == "", F.array(F.lit(False))).otherwise(F.transform(_split(x), lambda _: F.lit(True)))
        return F.flatten(F.transform(F.split(text, "\n"), words))

    return F.array_compact(F.transform(lines(text), lambda x, i: F.when(x, i)))


def _within(text: Column, lost: Column, least: int) -> Column:
    """Where `least` words begin that lie within the same lost lines."""
    words = F.transform(F.split(text, "\n"), lambda x: F.when(F.btrim(x, F.lit(WHITE)) == "", 0).otherwise(F.size(_split(x))))
    ahead = F.reduce(words, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

    def inside(first: Column) -> Column:
        wide = F.filter(F.transform(lost, lambda c: F.struct(F.get(first, c["b"]).alias("b"), F.get(first, c["e"] + 1).alias("end"))), lambda x: x["end"] - x["b"] >= least)
        return F.flatten(F.transform(wide, lambda x: F.sequence(x["b"], x["end"] - least)))

    return _bound(ahead, inside)


def cuts(docs: DataFrame, least: int = 50, gone: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash, cuts) of the documents that lose words: hash is the text's XXH64, cuts are (b, e) of
    word numbers, both inclusive, where a blank line counts as a word.

    Lines that `gone` (doc_id, hash, cuts, all) lists as cut are passed over: what lies within them stands
    earlier in any case, so no first place is among it. Copies of texts that `first` (hash, holder, shared) lists are
    passed over too: all their lines are cut.
    """
    gram = max(least // 4, 2)
    texts = docs.where(F.length("text") >= 2 * least - 1).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    if first is not None:
        texts = texts.join(first, "hash", "left").where(~copied()).select("doc_id", "hash", "text")
    reach = least - gram + 1
    words = texts.select(*KEY, _hashes(F.col("text")).alias("w")).withColumn("c", _pairs(F.col("w")))
    # outer, as the arrays would be made a second time for a filter on their size
    marks = words.select(*KEY, "w", "c", F.posexplode_outer("c").alias("k", "x")).where(_is_place(least, reach, gram))
    marks = saved(marks.select(*KEY, "k", F.expr(f"xxhash64(slice(w, k + 1, {gram}))").alias("f")), "passage-fingerprints")
    # not a window: a partition of a join that one fingerprint fills can be split
    often = marks.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    places = saved(marks.join(often.hint("shuffle_hash"), "f", "left_semi").groupBy(*KEY).agg(F.collect_list("k").alias("known")), "passage-places").alias("p")
    if gone is None:
        places = places.withColumn("lost", F.lit(None).cast(_CUT))
    else:
        places = places.join(gone.alias("l"), same("p", "l"), "left").where("not coalesce(l.all, false)").select("p.doc_id", "p.hash", "known", F.col("cuts").alias("lost"))
    found = texts.alias("t").join(places.alias("s").hint("shuffle_hash"), same("t", "s")).select("t.doc_id", "t.hash", "text", "known", "lost")
    blank = F.col("text").rlike(rf"(?:^|\n){_OWN}\n")
    found = found.select(*KEY, "text", "known", "lost", _hashes(F.col("text")).alias("w"), F.when(blank, _numbers(F.col("text"))).alias("i"))
    found = found.withColumn("c", _pairs(F.col("w"))).withColumn("new", F.array_except(_places(F.col("c"), reach, gram), F.col("known")))
    # each run ends in its text; whether a place is one hangs on two words by their own hashes, else on `reach` and one more
    new, chosen = F.sort_array("new"), lambda k: F.coalesce(F.get("c", k) < _LOW, F.lit(False))
    starts = _clear(F.filter(new, chosen), F.size("w") - gram + 1, reach)
    other = F.filter(new, lambda k: ~chosen(k))
    starts = F.when(F.size(other) == 0, starts).otherwise(F.array_intersect(starts, _clear(other, F.size("w") - reach, gram - 1)))
    found = found.withColumn("s", F.when(F.col("lost").isNull(), starts).otherwise(F.array_except(starts, _within(F.col("text"), F.col("lost"), least))))
    at = lambda x: F.expr(f"if(i is null, {x}, i[{x}])")
    runs = found.select(*KEY, "w", "i", F.explode_outer("s").alias("x")).where("x is not null")
    runs = runs.select(*KEY, F.expr(f"xxhash64(slice(w, x + 1, {least}))").alias("r"), at("x").alias("b"), at(f"x + {least - 1}").alias("e"))
    return merged(runs, [])


def without(docs: DataFrame, found: DataFrame, report: bool, drop: bool) -> DataFrame:
    """`docs` without what `found` (doc_id, hash, cuts of lines, words) lists, one row there for a document.

    Texts whose lines alone are cut are put together from slices of lines, others by left_over().
    """
    named = found.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__h"), F.col("cuts").alias("__lines"), F.col("words").alias("__words"))
    joined = docs.withColumn("__x", F.xxhash64("text")).join(named.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__x") == F.col("__h")), "left")
    hit = "(__lines is not null or __words is not null)"
    begin = "if(k = 0, 0, get(__lines, k - 1).e + 1)"
    gaps = f"transform(sequence(0, size(__lines)), k -> slice(ls, {begin} + 1, greatest(if(k = size(__lines), size(ls), get(__lines, k).b) - {begin}, 0)))"
    whole = f"transform(transform(array(split(text, '\\n')), ls -> flatten({gaps})), r -> if(size(r) > 0, concat(array_join(r, '\\n'), '\\n'), ''))[0]"
    nothing = F.array().cast(_CUT)
    torn = left_over(F.col("text"), F.coalesce("__lines", nothing), F.coalesce("__words", nothing))
    split = joined.withColumn("__left", F.when(F.expr("__words is not null"), torn).when(F.expr("__lines is not null"), F.expr(whole)))
    text = F.expr(f"if({hit}, left(__left, greatest(length(__left) - 1, 0)), text)")
    added = {"n_lines", "n_cut", "n_left", "n_chars_cut"} if report else set()
    kept = [c for c in docs.columns if c not in added]
    cut = split.withColumn("__text", text)
    out = [F.col("__text").alias("text") if c == "text" else F.col(c) for c in kept]
    if report:
        lines = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n"), F.lit("")))
        before = (lines(F.coalesce("text", F.lit(""))) + 1).cast(LongType())
        after = F.when(F.expr(hit), lines(F.col("__left"))).otherwise(before).cast(LongType())
        chars = F.coalesce(F.length("text") - F.length("__text"), F.lit(0)).cast(LongType())
        return cut.select(*out, before.alias("n_lines"), (before - after).alias("n_cut"), after.alias("n_left"), chars.alias("n_chars_cut"))
    if drop:
        # in a generator, as the texts would be made a second time for a filter on them
        cut = split.withColumn("__text", F.explode(F.filter(F.array(text), lambda x: ~F.expr(hit) | x.rlike(r"\S"))))
    return cut.select(*out)


def deduplicated(docs: DataFrame, least: int = 50, drop: bool = True) -> DataFrame:
    """`docs` with later repeated passages of `least` words or more cut from their texts.

    With `drop`, documents that lose all their words go. The order is that of doc_id, null first, then of
    the text's hash; rows that repeat both doc_id and text are one document and fare alike. Words are what
    lies between white space, which stays as it is but for that after the words cut: a passage that ends a
    line further down than it began leaves its line break. A null text stays null, other columns stay.
    """
    found = cuts(docs, least).select(*KEY, F.lit(None).cast(_CUT).alias("cuts"), F.col("cuts").alias("words"))
    return without(docs, saved(found, "cuts"), False, drop)
