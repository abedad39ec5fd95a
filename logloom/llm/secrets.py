"""Secret scans: known patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a secret by its form. Kinds are listed in the order of ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run with fewer than 20 characters matches nowhere
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = 6

#: Strings worth measuring: whole runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
# Character classes: name, what the whole string must match, alphabet, least entropy of some window in bits.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", 3.8),
)
#: What is never reported: UUIDs, marked examples, paths of words. Possessive groups need no stack on long paths.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|x{8}|0123456789|abcdefgh",
    r"^/?([A-Za-z]{1,19}+/)++[A-Za-z0-9_-]{0,19}$",
)
_SPAN = "array<struct<start:int,stop:int,kind:int,found:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches with their code points: the lengths of matches and of what lies between, summed up."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    last = lambda spans: F.coalesce(F.get(spans.stop, F.size(spans) - 1), F.lit(0))
    return F.aggregate(
        pairs, F.array().cast(_SPAN),
        lambda spans, p: F.concat(spans, F.array(F.struct(
            (last(spans) + p.gap).alias("start"), (last(spans) + p.gap + F.length(p.hit)).alias("stop"),
            F.lit(kind).alias("kind"), p.hit.alias("found"),
        )).cast(_SPAN)),
    )


def entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of ``window`` characters in a row; shorter strings are one window.

    The window slides by one character: two counts change, and with them the sum
    of ``n * log2(n)``, from which the entropy follows. Counts are packed into
    a few long numbers. Each character is read once, so time grows with the length.
    An empty string has none.
    """
    bits = (window + 1).bit_length()
    each = 63 // bits
    packs = len(alphabet) // each + 1
    weight = F.array(*[F.lit(n * log2(n) if n else 0.0) for n in range(window + 2)])
    codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(alphabet)))
    left = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.size(codes))  # what leaves as another enters
    moves = F.zip_with(codes, left, lambda i, o: F.struct(
        F.floor(i / each).cast("int").alias("ip"), (i % each * bits).alias("ib"),
        F.when(o >= 0, F.floor(o / each).cast("int")).otherwise(-1).alias("op"), (F.greatest(o, F.lit(0)) % each * bits).alias("ob")))
    none = F.struct(F.array_repeat(F.lit(0).cast("long"), packs).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    count = lambda n, pack, at: F.call_function("shiftright", F.get(n, pack), at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def change(n: Column, pack: Column, at: Column, by: int) -> Column:
        return F.transform(n, lambda v, k: F.when(k == pack, v + one(at) * by).otherwise(v))

    def enter(state: Column, move: Column) -> Column:
        before = count(state.n, move.ip, move.ib)
        gain = F.get(weight, before + 1) - F.get(weight, before)
        return F.struct(change(state.n, move.ip, move.ib, 1).alias("n"), (state.sum + gain).alias("sum"), state.best.alias("best"), (state.i + 1).alias("i"))

    def leave(state: Column, move: Column) -> Column:
        before = count(state.n, move.op, move.ob)
        loss = F.when(move.op >= 0, F.get(weight, before) - F.get(weight, before - 1)).otherwise(F.lit(0.0))
        total = state.sum - loss
        best = F.when(state.i >= window, F.greatest(state.best, F.lit(log2(window)) - total / window)).otherwise(state.best)
        return F.struct(change(state.n, move.op, move.ob, -1).alias("n"), total.alias("sum"), best.alias("best"), state.i.alias("i"))

    steps = F.flatten(F.transform(moves, lambda m: F.array(F.struct(m.alias("m"), F.lit(True).alias("enters")), F.struct(m.alias("m"), F.lit(False).alias("enters")))))
    step = lambda state, s: F.when(s.enters, enter(state, s.m)).otherwise(leave(state, s.m))
    short = lambda s: F.when(s.i == 0, F.lit(0.0)).otherwise(F.log2(s.i.cast("double")) - s.sum / s.i)
    return F.aggregate(steps, none, step, lambda s: F.when(s.i >= window, s.best).otherwise(short(s)))


def _suspect(string: Column) -> Column:
    """Whether a candidate's entropy reaches that of its character class; none of the allowed forms does."""
    allowed = F.lit(False)
    for form in ALLOWED:
        allowed = allowed | string.rlike(form)
    high = F.lit(False)
    for _, form, alphabet, least in reversed(CLASSES):
        high = F.when(string.rlike(form), entropy(string, alphabet) >= least).otherwise(high)
    return F.when(allowed, F.lit(False)).otherwise(high)


def scan(docs: DataFrame) -> DataFrame:
    """Find secrets in every text.

    Patterns give the base spans of three kinds; matches per kind are leftmost
    and do not overlap, and those too short are dropped. Other long strings are
    candidates: each belongs to a character class, a window slides over it, and
    the string is reported as ``entropy`` when the largest entropy of a window
    reaches the level of its class and no allow-list form fits. Candidates that
    overlap a base span add nothing.

    Returns one row per row of ``docs``: ``doc_id``, ``n_assign``, ``n_access``,
    ``n_hex``, ``base_sha256``, ``spans`` (``kind:start:end``, code points, end
    exclusive, by start and kind). Null and empty texts hold nothing. Repeated
    rows are scanned like others, very long strings whole, and other columns are
    not read.
    """
    text = F.col("_t")
    none = F.array().cast(_SPAN)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    short = lambda span: F.length(F.regexp_extract(span.found, "^" + ASSIGN, 2)) >= LEAST
    rows = rows.withColumns({
        "_assign": F.when(text.rlike(ASSIGN), F.filter(_spans(text, ASSIGN, 0), short)).otherwise(none),
        "_access": F.when(text.rlike(ACCESS), _spans(text, ACCESS, 1)).otherwise(none),
        "_hex": F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none),
        "_long": F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3)).otherwise(none),
    })
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    apart = lambda c: ~F.exists("_base", lambda b: (b.start < c.stop) & (c.start < b.stop))
    rows = rows.withColumn("_long", F.filter("_long", apart)).withColumn("_more", F.when(F.size("_long") > 0, F.filter("_long", lambda c: _suspect(c.found))).otherwise(none))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s.start, s.kind, s.stop))),
        lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.stop)), ",")
    return rows.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(F.col("_base")), 256).alias("base_sha256"), line(F.concat("_base", "_more")).alias("spans"),
    )
