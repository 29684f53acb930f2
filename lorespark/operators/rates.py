"""Anchored rate windows by doubling over successor links, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.joins import materialize, salted_join
from lorespark.operators.stats import RATE_LIMIT, WINDOW_SECONDS

#: Window widths whose first times are put in order by one task.
SPAN = 4096
#: Levels of links that one plan follows downwards before its result is written.
DEEP = 4


def _marked_cells(requests: DataFrame, width: int) -> DataFrame:
    """k, cell, head, before, n, closed: the cells of each key, as wide as a window.

    A request that comes a width or more after the one before it opens a window whatever came
    earlier. Only the first of a cell can be such a ``head``, as the others follow one in the same
    cell. ``before`` is the head of the cell before, whose window may end in this one; ``closed``
    tells that all requests of the cell are in the window of one of these two.
    """
    cells = requests.groupBy("k", "cell").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
    # Cells are looked through in spans; the last two of a span are looked at by the next one, too.
    span, place = F.expr(f"(cell - pmod(cell, {SPAN}L)) div {SPAN}L"), F.expr(f"pmod(cell, {SPAN}L)")
    spans = F.when(place >= SPAN - 2, F.array(span, span + 1)).otherwise(F.array(span))
    seen = cells.select("*", span.alias("own"), F.explode(spans).alias("span"))
    line = Window.partitionBy("k", "span").orderBy("cell")
    follows = (F.lag("cell").over(line) == F.col("cell") - 1) & (F.col("first") - F.lag("last").over(line) < width)
    heads = seen.withColumn("head", F.when(~F.coalesce(follows, F.lit(False)), F.col("first")))
    before = F.when(F.lag("cell").over(line) == F.col("cell") - 1, F.lag("head").over(line))
    marked = heads.withColumn("before", before).filter("span = own")
    closed = F.col("head").isNotNull() | F.coalesce(F.col("last") - F.col("before") < width, F.lit(False))
    return materialize(marked.select("k", "cell", "head", "before", "n", closed.alias("closed")))


def _times(requests: DataFrame) -> DataFrame:
    """k, x, n, start: different times (us, n) of each key, counted from its first one, in microseconds."""
    starts = requests.groupBy("k").agg(F.min("us").alias("start"))
    return materialize(
        salted_join(requests, starts, ["k"], spread=["us"]).select("k", (F.col("us") - F.col("start")).alias("x"), "n", "start")
    )


def _following(cells: DataFrame) -> DataFrame:
    """k, cell, following: the first time in a later cell, for every cell of (k, cell, first).

    Cells are looked through in spans; a span only needs the first time of the spans after it.
    """
    span = cells.withColumn("span", F.expr(f"cell div {SPAN}"))
    below = Window.partitionBy("k", "span").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("k").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = span.groupBy("k", "span").agg(F.min("first").alias("head")).select(
        "k", "span", F.last("head", ignorenulls=True).over(later).alias("beyond"))
    inside = span.withColumn("inside", F.last("first", ignorenulls=True).over(below))
    return inside.join(heads, ["k", "span"]).select("k", "cell", F.coalesce("inside", "beyond").alias("following"))


def successors(times: DataFrame, width: int) -> DataFrame:
    """k, x, leave: the first time at least ``width`` after each; null after the last window.

    It lies in the next cell of that width, or is the first time of a cell after that.
    """
    cell = F.expr(f"x div {width}L")
    own = times.select("k", "x", cell.alias("cell"), F.col("x").alias("at"), F.lit(False).alias("asks"))
    asked = times.select("k", "x", (cell + 1).alias("cell"), (F.col("x") + width).alias("at"), F.lit(True).alias("asks"))
    # From the latest time of a cell back to each asked one, equal times included.
    from_end = Window.partitionBy("k", "cell").orderBy(F.col("at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(asked)
    near = F.min(F.when(~F.col("asks"), F.col("x"))).over(from_end)
    found = materialize(both.select("*", near.alias("near")).filter("asks").select("k", "x", "cell", "near"))
    cells = both.groupBy("k", "cell").agg(F.min(F.when(~F.col("asks"), F.col("x"))).alias("first"))
    open_ends = found.filter("near IS NULL").join(_following(cells), ["k", "cell"])
    return found.filter("near IS NOT NULL").select("k", "x", F.col("near").alias("leave")).unionByName(
        open_ends.select("k", "x", F.col("following").alias("leave")))


def _lift(links: DataFrame, width: int, size: int) -> DataFrame:
    """Links that leave blocks of ``size``, from links that leave blocks of half that size.

    Only times at which a block can be entered stay: those in its first window width, and the
    first one after; of a key's first block, the key's first time.
    """
    block, place = F.expr(f"x div {size}L"), F.expr(f"x % {size}L")
    later = F.min(F.when(place >= width, F.col("x"))).over(Window.partitionBy("k", block))
    entries = links.withColumn("later", later).filter(
        (F.col("x") == 0) | ((F.col("x") >= size) & ((place < width) | (F.col("x") == F.col("later"))))).drop("later")
    inner = F.expr(f"leave div {size}L") == block
    steps = links.select("k", F.col("x").alias("leave"), F.col("leave").alias("then"))
    crossing = entries.filter(inner).join(steps, ["k", "leave"]).select("k", "x", F.col("then").alias("leave"))
    return entries.filter(~F.coalesce(inner, F.lit(False))).select("k", "x", "leave").unionByName(crossing)


def _openers(times: DataFrame, width: int) -> DataFrame:
    """k, x: the times that open windows.

    Upwards, links are doubled: those of a level leave blocks of twice the width of the level
    before, and only times that can enter a block are kept, so a level has about half the rows of
    the one below. Downwards, the entry of every block gives those of its halves.
    """
    levels = [materialize(successors(times.select("k", "x"), width))]
    last = levels[0].agg(F.max("x")).first()[0]
    if last is None:
        return levels[0].select("k", "x")
    size = width
    while size <= last:
        size *= 2
        levels.append(materialize(_lift(levels[-1], width, size)))
    entered = levels.pop().select("k", "x")
    while levels:
        inner = F.expr(f"leave div {size}L = x div {size}L")
        half = F.when(inner, F.array("x", "leave")).otherwise(F.array("x"))
        entered = entered.join(levels.pop(), ["k", "x"]).select("k", F.explode(half).alias("x"))
        size //= 2
        if len(levels) % DEEP == 0:
            entered = materialize(entered)
    return entered


def _chained(times: DataFrame, width: int) -> DataFrame:
    """k, opened, requests: windows of times (k, x, n, start), the first of each key opening one.

    The first time at least a window after another is its successor; the openers are the times on
    the way of successors from a key's first one, found in log2(time span / window) rounds.
    """
    cell = F.expr(f"x div {width}L")
    # A window covers its cell to the end, so a cell has one opener at most.
    openers = materialize(_openers(times, width).select("k", cell.alias("cell"), F.col("x").alias("opener")))
    placed = times.withColumn("cell", cell).join(openers, ["k", "cell"], "left")
    before = F.col("opener").isNull() | (F.col("x") < F.col("opener"))
    counts = placed.groupBy("k", (F.col("cell") - before.cast("long")).alias("cell"), "start").agg(
        F.sum("n").alias("requests"))
    return counts.join(openers, ["k", "cell"]).select("k", (F.col("start") + F.col("opener")).alias("opened"), "requests")


def anchored_rate_windows(
    requests: DataFrame, width_seconds: int = WINDOW_SECONDS, limit: int = RATE_LIMIT
) -> DataFrame:
    """Windows per key: the first request opens one, requests until it expires count.

    Requests over ``limit`` in a window are rejected but still count. Returns key,
    opened_at, requests, rejected. Equal times are merged first; a null key is a key of its own;
    requests without a time are left out.

    A request after a pause of a window or more opens one, so most windows of a key that asks
    now and then are known from its cells. Requests that come after such a window without a pause
    are chained; no other is moved for that. What is left of a key by taking away the windows
    after its pauses has the remaining openers: the way of successors that ends before a pause goes
    on at the next request that is left, which opens a window itself. Tasks work on one cell of a key
    as wide as a window, or on the summed cells of a span, never on a whole key.
    """
    width = width_seconds * 1_000_000
    # Inside a struct a null key equals itself.
    asked = requests.filter("ts IS NOT NULL").select(
        F.struct("key").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    ).withColumn("cell", F.expr(f"(us - pmod(us, {width}L)) div {width}L"))
    cells = _marked_cells(asked, width)
    opened = F.coalesce("head", "before").alias("opened")
    whole = cells.filter("closed").select("k", opened, "n")
    # Times of the other cells: up to the end of the window before, and those that are left.
    times = materialize(
        asked.join(cells.filter("NOT closed").select("k", "cell", "before"), ["k", "cell"])
        .groupBy("k", "us", "before").agg(F.count("*").alias("n")))
    inside = F.coalesce(F.col("us") - F.col("before") < width, F.lit(False))
    tails = times.filter(inside).select("k", F.col("before").alias("opened"), "n")
    counts = whole.unionByName(tails).groupBy("k", "opened").agg(F.sum("n").alias("requests"))
    chained = _chained(_times(times.filter(~inside).select("k", "us", "n")), width)
    return counts.unionByName(chained).select(
        F.col("k.key").alias("key"), F.timestamp_micros("opened").alias("opened_at"), "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))
