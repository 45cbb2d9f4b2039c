"""Sliding token windows with labels by interval overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import lines, words

PAD, UNKNOWN = 0, 1


def token_lines(text: Column) -> Column:
    """array(struct(token, line)): lower-case words of each line; a word never spans lines."""
    return F.flatten(F.transform(lines(text), lambda x, i: F.transform(words(x, lower=True), lambda t: F.struct(t.alias("token"), (i + 1).alias("line")))))


def stride_of(body: int, overlap: float) -> int:
    return max(1, body - round(body * overlap))


def window_starts(n: Column, body: int, stride: int) -> Column:
    """0-based starts: every stride, the last window right-aligned; short files have one window."""
    many = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(n - body, F.lit(0)), F.lit(stride)), F.array(F.greatest(n - body, F.lit(0)))))
    return F.when(n <= body, F.array(F.lit(0))).otherwise(many)


def build_windows(files: DataFrame, body: int = 1024, overlap: float = 0.25, mode: str = "window", tokenize: Callable[[Column], Column] = token_lines) -> DataFrame:
    """(row_id, win, s, e, l0, l1, tokens, labels, file_annotated).

    files: row_id, text, spans (array of struct cls, start, end), labels. A window has a class if one
    of its spans overlaps the window's lines; the spans lie in the row, so this is a filter over an
    array and no join. truncate: the first window only, with the file's labels. ``tokenize`` gives a text's tokens, each with the
    line on which it starts; the first and last lines belong to the first and last windows even if no token starts on them.
    """
    if mode not in ("window", "truncate"):
        raise ValueError(f"unknown mode {mode!r}")
    based = files.select("row_id", "spans", "labels", F.size(lines(F.col("text"))).alias("n_lines"), tokenize(F.col("text")).alias("t"))
    flat = based.select("*", F.size("t").alias("n"), F.posexplode(window_starts(F.size("t"), body, stride_of(body, overlap))).alias("win", "s"))
    e = F.least(F.col("s") + body, F.col("n"))
    line = lambda i: F.coalesce(F.try_element_at("t", i)["line"], F.lit(1))
    l0 = F.when(F.col("s") == 0, 1).otherwise(line(F.col("s") + 1))
    l1 = F.when(e == F.col("n"), F.greatest(F.when(e > 0, line(e)).otherwise(1), F.col("n_lines"))).otherwise(line(e))
    cut = flat.withColumn("e", e).withColumn("l0", l0).withColumn("l1", l1).withColumn("tokens", F.transform(F.slice("t", F.col("s") + 1, F.greatest(e - F.col("s"), F.lit(0))), lambda x: x["token"]))
    hit = F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda p: (p["start"] <= F.col("l1")) & (p["end"] >= F.col("l0"))), lambda p: p["cls"])))
    if mode == "truncate":
        cut, hit = cut.where("win = 0"), F.col("labels")
    return cut.select("row_id", "win", "s", "e", "l0", "l1", "tokens", hit.alias("labels"), (F.size(F.col("labels")) > 0).alias("file_annotated"))


#: words of Java's pattern, where white space is ASCII's
_WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]"


class LineWindower:
    """What a windower is: ``token_type`` (SQL), ``body`` (tokens that fit a window of a length) and ``tokenize`` (a text's tokens with the line of each)."""

    token_type = "string"

    def body(self, length: int) -> int:
        return length

    def tokenize(self, text: str) -> list[tuple[object, int]]:
        import regex

        return [(t, i) for i, x in enumerate(text.split("\n"), 1) for t in regex.findall(_WORD, x.lower())]


def register_windows(spark, name: str = "text_windows", windower: object | None = None) -> None:
    """A table function ``name(text, length, overlap)`` for SQL: (win, s, e, l0, l1, tokens) of a text's windows, as ``build_windows`` makes them.

    ``select f.row_id, w.* from files f, lateral text_windows(f.text, 200, 0.25D) w``. The schema comes from the windower when a query is
    analysed, as do errors in length and overlap, which must be constants. Rows are independent: the function runs where they lie.
    """
    from pyspark.sql import types as T
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

    from strataweave.session import ship

    ship(spark)
    windower = windower or LineWindower()
    # the analysis runs where there is no session to parse types
    schema = T._parse_datatype_string(f"win int, s int, e int, l0 int, l1 int, tokens array<{windower.token_type}>")

    class TextWindows:
        @staticmethod
        def analyze(text: AnalyzeArgument, length: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType | T.NullType):
                raise ValueError("the first argument must be a text")
            if not length.isConstantExpression or not overlap.isConstantExpression:
                raise ValueError("length and overlap must be constants")
            if length.value is None or int(length.value) < 1 or overlap.value is None or not 0 <= float(overlap.value) < 1:
                raise ValueError("length must be positive and overlap in [0, 1)")
            return AnalyzeResult(schema)

        def eval(self, text, length, overlap):
            found = windower.tokenize(text or "")
            body, n, n_lines = windower.body(int(length)), len(found), (text or "").count("\n") + 1
            step = stride_of(body, float(overlap))
            starts = [0] if n <= body else [*range(0, n - body, step), n - body]
            for win, s in enumerate(starts):
                e = min(s + body, n)
                first = 1 if s == 0 else found[s][1]
                last = found[e - 1][1] if e else 1
                yield win, s, e, first, max(last, n_lines) if e == n else last, [t for t, _ in found[s:e]]

    spark.udtf.register(name, udtf(TextWindows))


def window_stats(windows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, windows, windows per file (mean, max), median tokens, positive windows, label visibility.

    Visibility: share of annotated (file, class) pairs that a window holds.
    """
    per_file = windows.groupBy("row_id").agg(F.count("*").alias("k"), F.max("e").alias("tokens"), F.count_if(F.size("labels") > 0).alias("pos"))
    base = per_file.agg(F.count("*").alias("files"), F.coalesce(F.sum("k"), F.lit(0)).alias("windows"), F.round(F.coalesce(F.avg("k"), F.lit(0.0)), 2).alias("windows_per_file_mean"), F.coalesce(F.max("k"), F.lit(0)).alias("windows_per_file_max"), F.floor(F.coalesce(F.median("tokens"), F.lit(0.0))).alias("tokens_per_file_median"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positive_windows"))
    pairs = files.select("row_id", F.explode("labels").alias("cls"))
    seen = windows.select("row_id", F.explode("labels").alias("cls")).distinct().withColumn("seen", F.lit(1))
    visible = pairs.join(seen, ["row_id", "cls"], "left").agg(F.round(F.coalesce(F.sum(F.coalesce("seen", F.lit(0))) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 4).alias("label_visibility"))
    return base.crossJoin(visible)  # one row each


def group_windows(windows: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, wins): a file's windows in order; a file without one is an error."""
    grouped = windows.groupBy("row_id").agg(F.array_sort(F.collect_list("win")).alias("wins"))
    if lost := files.select("row_id").join(grouped, "row_id", "left_anti").limit(5).collect():
        raise ValueError(f"files without windows: {[r['row_id'] for r in lost]}")
    return grouped


def vocabulary(files: DataFrame, size: int = 30_000, least: int = 2, text: str = "text") -> DataFrame:
    """(token, id, n): the size - 2 most frequent words seen at least ``least`` times, ids from 2; ties by token."""
    counts = files.select(F.explode(words(F.col(text), lower=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(size - 2)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).cast("int")).select("token", "id", "n")


def encode_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds id to rows with ``token``; words out of the vocabulary have ``UNKNOWN``. Whether the vocabulary is broadcast is the planner's choice, by its size."""
    return tokens.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(UNKNOWN)))


def frame(body: Column, prefix: list[int], suffix: list[int]) -> Column:
    whole = lambda ids: F.array(*[F.lit(i) for i in ids]).cast("array<int>")
    return F.concat(whole(prefix), body, whole(suffix))


def padded(ids: Column, length: Column) -> tuple[Column, Column]:
    """(ids, mask) at a length rounded up to a multiple of 8."""
    full = (F.ceil(length / 8) * 8).cast("int")
    gap = F.greatest(full - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(PAD), gap)), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))
