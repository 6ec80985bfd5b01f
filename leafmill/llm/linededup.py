"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines' hashes, blank lines aside. A window is the fewest consecutive lines
that hold `least_words` words, from each line on, and the smallest hash in it is a fingerprint: any run of
so many words that stands in two places has a fingerprint in common, whatever stands around it. Where a
fingerprint repeats, its positions are joined to the documents' lines, and the windows around it are laid
out in both directions, forwards from each line and backwards from each line. A window whose lines don't
stand there for the first time, in the order of doc_id, is deleted; overlapping ones make up the longest
repeated runs. So a line goes exactly if it lies in a run of `least_words` words or more that stands earlier
in any document, or further up in its own. Each line cut still stands earlier, and so in the end somewhere.

A text that stands whole under a smaller doc_id is a copy: all its lines go if they have `least_words` words, and
nothing in it stands for the first time, so only its first holder is looked at further. Groups of copies, however large,
are a row each in the counts.

`passages` does the same for words within lines. Both find their cuts in the texts as they came, and both
are applied at once. Rows are windows, never pairs of documents or places, and their number grows with the
input. Equality is that of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import saved
from .passages import KEY, WHITE, copied, merged, repeated, same


def _lines(text: Column) -> Column:
    """Lines that aren't blank: i, their number; h, their hash without outer white space; n, their words.

    Text without blanks between words counts by its bytes beyond ASCII, six to a word.
    """

    def lines(trim, words) -> Column:
        trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), trim(x).alias("x")))
        full = F.filter(trimmed, lambda x: x["x"] != F.lit(""))
        return F.transform(full, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["x"]).alias("h"), words(x["x"]).alias("n")))

    def blanks(x: Column) -> Column:
        return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1

    def runs(x: Column) -> Column:
        """The words of a line, with more than one blank between them perhaps."""
        return F.when(F.contains(x, F.lit("  ")), F.size(F.array_remove(F.split(x, " "), ""))).otherwise(blanks(x))

    beyond = lambda x: F.floor((F.octet_length(x) - F.length(x)) / 6).cast("int")
    odd = F.lit(False)
    for c in WHITE[1:]:
        odd = odd | F.contains(text, F.lit(c))
    split = lines(lambda x: F.btrim(x, F.lit(WHITE)), lambda x: F.greatest(F.size(F.split(x, r"\s+")), beyond(x)))
    plain, wide = lines(F.trim, runs), lines(F.trim, lambda x: F.greatest(runs(x), beyond(x)))
    return F.when(odd, split).when(F.octet_length(text) == F.length(text), plain).otherwise(wide)


def _fingerprints(hashes: str, fs: str) -> str:
    """SQL for the fingerprints `fs` of a document: f, and n, 2 if it stands in `hashes`, of which they are, twice or more, else 1."""
    twice = f"transform(array(sort_array({hashes})), q -> array_distinct(filter(q, (x, i) -> i > 0 and x = q[greatest(i - 1, 0)])))[0]"
    return f"transform(array({twice}), q -> transform(array_distinct(array_compact({fs})), x -> named_struct('f', x, 'n', if(array_contains(q, x), 2, 1))))[0]"


def cuts(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """(doc_id, hash, cuts, all) of the documents that lose lines: hash is the text's XXH64, cuts are (b, e) of
    line numbers, both inclusive, with the blank lines up to the next, and `all` tells that no line is left but
    blank ones."""
    return _cuts(docs, least_words, holders(docs))[0]


def holders(docs: DataFrame) -> DataFrame:
    """(hash, holder, shared) of the texts that several rows have: the first doc_id that has it, null before all."""
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash")).groupBy("hash").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return saved(rows.where("n > 1").select("hash", F.col("first.doc_id").alias("holder"), F.lit(True).alias("shared")), "holders")


def _cuts(docs: DataFrame, least_words: int, first: DataFrame) -> tuple[DataFrame, bool]:
    """The cuts, and whether each document with a line has a doc_id of its own, not null. `first` is holders()."""
    frame = docs.select("doc_id", F.xxhash64("text").alias("hash"), _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    frame = frame.select(*KEY, F.col("lines.i").alias("i"), F.col("lines.h").alias("h"), F.col("lines.n").alias("n"))
    # no filter before it is saved: it would be pushed down, and the lines made twice
    lines = saved(frame.join(first, "hash", "left").select(*KEY, "i", "h", "n", copied().alias("copy")), "lines").where(F.size("h") > 0)
    ids = lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    known = ids.agg(F.max("n").alias("rows"), F.expr("bool_or(doc_id is null or low <> high)").alias("shared")).first()
    if (known["rows"] or 0) > 1:
        lines = saved(lines.dropDuplicates(KEY), "lines")
    copies, lines = lines.where("copy"), lines.where("not copy")
    enough = least_words * 1000
    reach = lambda part: f"aggregate({part}, 0L, (a, x) -> if(a >= {enough}, a, a + x * 1000L + 1))"
    #: From each line on, and back from each line: 1000 times the words of the window, plus its lines.
    ahead = F.expr(f"transform(sequence(0, size(n) - 1), s -> {reach(f'slice(n, s + 1, {least_words})')})")
    back = F.expr(f"transform(sequence(0, size(n) - 1), t -> {reach(f'reverse(slice(n, greatest(t - {least_words} + 2, 1), least({least_words}, t + 1)))')})")
    minima = F.expr(f"transform(ahead, (a, s) -> if(a >= {enough}, array_min(slice(h, s + 1, cast(a % 1000 as int))), null))")
    chosen = lines.withColumn("ahead", ahead).withColumn("f", minima)
    places = repeated(chosen.select(*KEY, F.explode_outer(F.expr(_fingerprints("h", "f"))).alias("x")).where("x is not null").select(*KEY, "x.f", "x.n"), "line")
    found = lines.alias("d").join(places.alias("p"), same("d", "p")).select("d.doc_id", "d.hash", "i", "h", "n", "fs")
    found = found.withColumn("ahead", ahead).withColumn("f", minima).withColumn("back", back)
    window = "named_struct('r', xxhash64(slice(h, {s} + 1, {t} - {s} + 1)), 'b', i[{s}], 'e', coalesce(get(i, {t} + 1) - 1, i[{t}]))"
    forward = f"transform(filter(transform(ahead, (a, s) -> named_struct('s', s, 't', s + cast(a % 1000 as int) - 1)), x -> ahead[x.s] >= {enough} and array_contains(fs, f[x.s])), x -> {window.format(s='x.s', t='x.t')})"
    backward = f"transform(filter(transform(back, (a, t) -> named_struct('s', t - cast(a % 1000 as int) + 1, 't', t)), x -> back[x.t] >= {enough} and x.s + ahead[x.s] % 1000 - 1 <> x.t and array_contains(fs, f[x.s])), x -> {window.format(s='x.s', t='x.t')})"
    runs = found.select(*KEY, F.element_at("i", 1).alias("top"), F.element_at("i", -1).alias("end"), F.explode_outer(F.concat(F.expr(forward), F.expr(backward))).alias("x"))
    found = merged(runs.select(*KEY, "top", "end", "x.*"), ["top", "end"])
    found = found.select(*KEY, "cuts", F.expr("size(cuts) = 1 and cuts[0].b = top and cuts[0].e = end").alias("all"))
    whole = copies.where(f"aggregate(n, 0L, (a, x) -> a + x) >= {least_words}")
    whole = whole.select(*KEY, F.array(F.struct(F.element_at("i", 1).alias("b"), F.element_at("i", -1).alias("e"))).alias("cuts"), F.lit(True).alias("all"))
    return found.union(whole), not known["shared"]


def deduplicated(docs: DataFrame, least_words: int = 10, passage: int | None = 50, report: bool = False, drop: bool = True) -> DataFrame:
    """`docs` with later repeated runs cut from their texts: of whole lines with `least_words` words or more,
    and, unless `passage` is None, of `passage` words or more wherever they begin and end. With `report`,
    n_lines, n_cut (lines that are gone), n_left and n_chars_cut replace columns of these names.

    With `drop` and without `report`, documents that lose lines or words and have none left go; documents
    that were empty before stay. Runs count in the order of doc_id, null first, then of the text's hash.
    Rows that repeat both doc_id and text are one document and fare alike. Lines are compared without outer
    white space, words without regard to any. Blank lines up to the next line go with a line that is cut; a
    passage that ends a line further down than it began leaves its line break. A null text stays null, other columns
    stay as they are. An empty table gives an empty one.
    """
    first = holders(docs)
    found, single = _cuts(docs, least_words, first)
    lines = saved(found, "line-cuts")
    kind = "array<struct<b: int, e: int>>"
    found = lines.select(*KEY, "cuts", F.lit(None).cast(kind).alias("words"))
    if passage is not None:
        inside = passages.cuts(docs, passage, lines, first).select(*KEY, F.lit(None).cast(kind).alias("cuts"), F.col("cuts").alias("words"))
        found = found.union(inside).groupBy(*KEY).agg(F.first("cuts", True).alias("cuts"), F.first("words", True).alias("words"))
    return passages.without(docs, saved(found, "cuts"), report, drop)
