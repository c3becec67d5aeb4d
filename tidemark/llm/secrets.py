"""Secret scans: keyword and key-format patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are long runs of key characters outside the spans of the patterns.
Each is read once by a window that keeps a count per character; when the window
moves, only the counts of the character that leaves and of the one that enters
change, and with them the sum of n*log2(n) from which the entropy follows. A
candidate's class (hexadecimal or the wider key alphabet) sets the threshold,
and an allow-list suppresses what is known to be harmless. Only DataFrame
functions are used, in one pass over a row, without any exchange.

Positions are code points, end exclusive. They come from the lengths of the
matches and of the pieces between them, summed in blocks (``arrays.running``),
and pieces of the text are cut from chunks of it, so that the cost of a text is
in proportion to its length, however long a candidate is and however many
matches there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import chunked, cut, let, running
from tidemark.llm.common import shielded


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Kind and pattern, in the order in which kinds with one start are listed.
BASE_KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
ENTROPY_KIND = "entropy"
ASSIGN_VALUE = 8

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that a window must reach, by class: the class's pattern, in the order of tests.
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("key", r"^", 3.8))
#: Harmless candidates, as a whole: without digits or without letters, UUIDs, times in basic format, published examples.
ALLOWED = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2,6}(Z|[+-][0-9]{2,4})?$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
)
#: n*log2(n) in millionths, so that sums are whole numbers.
SCALE = 1_000_000


def weighted(n: int) -> int:
    return round(SCALE * n * math.log2(n)) if n > 1 else 0


def most_weight(bits: float, window: int = WINDOW) -> int:
    """A window has at least ``bits`` of entropy if its summed n*log2(n) is at most this."""
    return math.floor(SCALE * window * (math.log2(window) - bits))


_SPANS = "array<struct<start:int,k:int,end:int,kind:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _spans(text: Column, found: Column, pattern: str, kind: str, order: int) -> Column:
    """Spans of all matches, from the pieces between them."""
    gaps, sizes = F.transform(F.split(text, pattern), F.length), F.transform(found, F.length)

    def placed(steps: Column) -> Column:
        before = running(F.transform(steps, lambda x: x["gap"] + x["len"]), lambda a, x: a + x)
        span = lambda z: F.struct(
            (z["at"] + z["x"]["gap"]).alias("start"), F.lit(order).alias("k"), (z["at"] + z["x"]["gap"] + z["x"]["len"]).alias("end"), F.lit(kind).alias("kind")
        )
        return F.transform(F.arrays_zip(before.alias("at"), steps.alias("x")), span)

    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("len"))
    return F.when(F.size(found) > 0, let(steps, placed)).otherwise(_none(_SPANS))


def least_weight(candidate: Column, window: int = WINDOW) -> Column:
    """The least summed n*log2(n) over all windows of a candidate (of ``window`` characters or more of ALPHABET).

    The counts are small fields of a few whole numbers: a step adds one to the
    field of the character that comes and takes one from that of the one that goes.
    """
    bits = (window + 1).bit_length()
    fields = 63 // bits
    gain = F.array(*[F.lit(weighted(n + 1) - weighted(n)).cast("long") for n in range(window + 1)])
    zero = F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // fields + 1)
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def steps(codes: Column) -> Column:
        """Per character: the word and the shift of its count, and those of the one ``window`` places before (-1: none)."""
        come = F.transform(codes, lambda c: F.struct(F.floor(c / fields).cast("int").alias("word"), ((c % fields) * bits).alias("shift")))
        none = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"))
        return let(come, lambda x: F.arrays_zip(x.alias("i"), F.slice(F.concat(F.array_repeat(none, window), x), 1, F.size(x)).alias("o")))

    one = F.lit(1).cast("long")
    shifted = lambda at: F.call_function("shiftleft", one, at["shift"])
    count = lambda n, at: F.call_function("shiftright", F.get(n, at["word"]), at["shift"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def moved(acc: Column, x: Column) -> Column:
        come, gone = x["i"], x["o"]
        leaves = gone["word"] >= 0
        change = F.get(gain, count(acc["n"], come)) - F.when(leaves, F.get(gain, count(acc["n"], gone) - 1)).otherwise(F.lit(0).cast("long"))
        return F.struct(
            F.transform(
                acc["n"],
                lambda n, w: n + F.when(w == come["word"], shifted(come)).otherwise(0) - F.when(w == gone["word"], shifted(gone)).otherwise(0),
            ).alias("n"),
            F.when(come == gone, acc["total"]).otherwise(acc["total"] + change).alias("total"),
            F.when(leaves, F.least(acc["best"], acc["total"])).otherwise(acc["best"]).alias("best"),  # the window before this step
        )

    return F.aggregate(
        let(codes, steps),
        F.struct(zero.alias("n"), F.lit(0).cast("long").alias("total"), F.lit(1 << 60).cast("long").alias("best")),
        moved,
        lambda acc: F.least(acc["best"], acc["total"]),
    )


def _flagged(candidate: Column, window: int, classes, allowed) -> Column:
    limit = F.lit(None).cast("long")
    for _, pattern, bits in reversed(classes):
        limit = F.when(candidate.rlike(pattern), F.lit(most_weight(bits, window)).cast("long")).otherwise(limit)
    harmless = F.lit(False)
    for pattern in allowed:
        harmless = harmless | candidate.rlike(pattern)
    return F.when(harmless, F.lit(False)).otherwise(least_weight(candidate, window) <= limit)


def _where(array: str, by: str, test) -> Column:
    """Elements of one array by a test of the other's at the same place.

    The arrays are zipped first: a column looked up inside a lambda may be
    computed again for every element, where the optimizer merges projections.
    """
    zipped = F.arrays_zip(F.col(array).alias("x"), F.col(by).alias("by"))
    return F.transform(F.filter(zipped, lambda z: test(z["by"])), lambda z: z["x"])


def _replaced(text: Column, spans: Column, fill) -> Column:
    """``text`` with its spans (by start) replaced: ``fill`` gives what stands for the struct (start, end, reach).

    ``reach`` is where the spans before it end; what a span shares with those
    is theirs.
    """

    def pieces(both: Column) -> Column:
        ends = running(F.transform(both["s"], lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        joined = lambda z: F.concat(
            cut(both["c"], z["reach"], z["x"]["start"]), fill(z["x"]["start"], z["x"]["end"], z["reach"])
        )
        out = F.transform(F.arrays_zip(both["s"].alias("x"), ends.alias("reach")), joined)
        last = F.array_max(F.transform(both["s"], lambda x: x["end"]))
        return F.concat(F.array_join(out, ""), cut(both["c"], last, both["n"]))

    both = F.struct(spans.alias("s"), chunked(text).alias("c"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(both, pieces)).otherwise(text)


def scanned(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``docs`` with ``base_found`` and ``secret_spans``: arrays of (start, k, end, kind) by start, then kind.

    Per kind of BASE_KINDS matches are leftmost and do not overlap; matches
    under the least length are dropped. Entropy spans are whole candidates in
    the text outside the base spans, so what stands beside a base span is
    judged too. A null text counts as empty and has no span; texts of any length are read
    whole, at a cost in proportion; repeated rows and an empty table give as
    many rows; spans with one start are listed by kind. Columns of ``docs`` with
    the names added here are replaced, all others stay.
    """
    docs, back = shielded(
        docs.drop("base_found", "secret_spans"), ["_text", "_rest", "_candidate", "_value", "_high", "_run", *[f"_{k}" for k, _ in BASE_KINDS]]
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    matches = docs.select(*kept, text.alias("_text"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{kind}") for kind, p in BASE_KINDS])
    spans = matches.select(
        *kept,
        "_text",
        *[_spans(F.col("_text"), F.col(f"_{kind}"), p, kind, k).alias(f"_{kind}") for k, (kind, p) in enumerate(BASE_KINDS)],
        F.when(F.size("_assign") > 0, F.transform(F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)), F.length)).otherwise(_none("array<int>")).alias("_value"),
    )
    base = spans.select(
        *kept, "_text", F.sort_array(F.concat(_where("_assign", "_value", lambda n: n >= ASSIGN_VALUE), "_access", "_hex")).alias("base_found")
    )
    blank = lambda start, end, reach: F.repeat(F.lit(" "), F.greatest(end, reach) - F.greatest(start, reach))
    rest = base.select(*kept, "base_found", _replaced(F.col("_text"), F.col("base_found"), blank).alias("_rest"))
    runs = rest.select(*kept, "base_found", "_rest", F.regexp_extract_all("_rest", F.lit(CANDIDATE), F.lit(0)).alias("_candidate"))
    judged = runs.select(
        *kept,
        "base_found",
        F.transform("_candidate", lambda c: _flagged(c, window, classes, allowed)).alias("_high"),
        _spans(F.col("_rest"), F.col("_candidate"), CANDIDATE, ENTROPY_KIND, len(BASE_KINDS)).alias("_run"),
    )
    return judged.select(
        *kept, "base_found", F.sort_array(F.concat("base_found", _where("_run", "_high", lambda high: high))).alias("secret_spans")
    ).withColumnsRenamed(back)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, mark: str = "[secret]", **kwargs) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans get one mark.

    No row is dropped; other columns stay, and a null text stays null.
    """
    docs, back = shielded(docs, ["base_found", "secret_spans"])
    names = docs.columns
    found = scanned(docs, **kwargs)
    marked = lambda start, end, reach: F.when(start >= reach, F.lit(mark)).otherwise(F.lit(""))
    clean = _replaced(F.col("text"), F.col("secret_spans"), marked)
    return found.withColumn("text", clean).select(*[f"`{c}`" for c in names]).withColumnsRenamed(back)
