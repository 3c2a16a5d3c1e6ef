"""Secret scanning with multipart credential linking, in DataFrame functions only.

Parts.  ``assign``, ``access`` and ``hex`` are reported wherever they stand.  ``blob`` (a long run of mixed case and
digits), ``ident`` (a login or client id assignment) and ``endpoint`` (a URL or host with port) are weak: alone they
mean nothing.  Each part has a role: access and ident identify, assign, hex and blob are secret, endpoint is where.

Linking.  Parts of one document are in scope of one another if they don't overlap and at most ``reach`` characters lie
between them: the same characters are never two parts of one credential.  A blob is reported if an identifying part
is in scope, an ident if a secret is, an endpoint if both are; a weak part that overlaps a reported one is the same
thing and is dropped.  The interval join needs no pairs: each part is an event at its start and one at its end, and
with a document's events in order the last end of a role before a start, and the first start of a role after an end,
are running maxima and minima.

Positions.  Each kind's matches are wrapped in private-use marks by one ``regexp_replace`` (after any such marks
in the text itself have been put out of the way, one character for one), the text is split at the marks, and
running sums of the pieces' lengths are the positions, in code points.  Pieces become rows that hold numbers
only; documents are dealt by a row number, once, and one document's parts are all that ever stands together.

Defined cases: null text is empty; a document without parts has empty lists; equal rows and equal or null
doc_ids each keep their row; an empty table gives an empty result; other columns don't matter (``redact`` keeps
them); very long texts and any number of matches are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, VALUE = "", "", ""
WORD = r"A-Za-z0-9+/_-"
#: kind: (pattern, least characters of its value, role); the value is group 2 if there is one.  In order of report.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 8, "secret"),
    "access": (r"()(AKIA[A-Z0-9]+)", 16, "identity"),
    "hex": (r"()([0-9a-f]{32,})", 32, "secret"),
}
WEAK = {
    "blob": (rf"()((?<![{WORD}])[{WORD}]{{20,}}={{0,2}})", 20, "secret"),
    "ident": (r"((?i:client_?id|key_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9_.@+-]+)", 3, "identity"),
    "endpoint": (r"()(https?://[^\s\"'<>]+|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9]))", 8, "place"),
}
KINDS = BASE | WEAK
REACH = 200
PLACEHOLDER = "[SECRET]"


def _unmarked(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)) | F.contains(text, F.lit(VALUE))
    return F.when(marked, F.translate(text, OPEN + CLOSE + VALUE, "???")).otherwise(text)


def _pieces(text: Column, kind: str, order: int) -> Column:
    """array<struct(kind, nth, size, gap, good)>: piece 0 is what stands before the first match; of the others,
    ``size`` characters are the match and ``gap`` follow it.  Empty if nothing matches."""
    pattern, least, _ = KINDS[kind]
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$1{VALUE}$2{CLOSE}"), OPEN)

    def one(piece: Column, nth: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        value = F.substring_index(match, VALUE, -1)
        good = F.char_length(value) >= least
        if kind == "blob":
            good = good & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        first = nth == 0
        size = F.when(first, F.lit(0)).otherwise(F.char_length(match) - 1)
        return F.struct(F.lit(order).alias("kind"), nth.alias("nth"), size.alias("size"),
                        F.when(first, F.char_length(piece)).otherwise(F.char_length(piece) - F.char_length(match) - 1).alias("gap"),
                        (~first & good).alias("good"))

    return F.when(F.size(pieces) > 1, F.transform(pieces, one)).otherwise(F.array().cast("array<struct<kind:int,nth:int,size:int,gap:int,good:boolean>>"))


def scan(docs: DataFrame, reach: int = REACH, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: ``carry`` (a struct of those columns), base and spans (arrays of struct(start, kind,
    end, before); kind counts in the order of ``KINDS``, before is the greatest end so far)."""
    names = list(KINDS)
    text = docs.select(F.struct(*carry).alias("carry"), _unmarked(F.col("text")).alias("t"))
    found = text.select("carry", F.monotonically_increasing_id().alias("key"),
                        F.concat(*[_pieces(F.col("t"), k, i) for i, k in enumerate(names)]).alias("parts"))
    rows = found.select("key", "carry", F.posexplode_outer("parts").alias("at", "p"))
    first = F.coalesce("at", F.lit(0)) == 0
    rows = rows.select("key", F.when(first, F.col("carry")).alias("carry"), "p.*").repartition("key")

    so_far = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size") + F.col("gap")).over(so_far), F.lit(0)))
    rows = rows.withColumn("end", F.col("start") + F.col("size")).withColumn("good", F.coalesce("good", F.lit(False)))

    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    strong = F.col("good") & (F.col("kind") < len(BASE))
    hidden = F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    rows = rows.withColumn("part", F.col("good") & (strong | ~hidden))

    # an end comes before a start at the same place: parts that touch don't overlap
    at = lambda where, what: F.struct(F.col(where).alias("at"), F.lit(what).alias("what"))
    both = F.when(F.col("part"), F.array(at("end", 0), at("start", 1))).otherwise(F.array(at("start", 2)))
    events = rows.select("key", "carry", "kind", "nth", "start", "end", "part", F.explode(both).alias("e"))
    order = Window.partitionBy("key").orderBy("e.at", "e.what")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        mine = F.col("part") & F.col("kind").isin([i for i, k in enumerate(names) if KINDS[k][2] == role])
        last_end = F.max(F.when(mine & (F.col("e.what") == 0), F.col("e.at"))).over(earlier)
        next_start = F.min(F.when(mine & (F.col("e.what") == 1), F.col("e.at"))).over(later)
        back = (F.col("e.what") == 1) & (F.col("start") - last_end <= reach)
        ahead = (F.col("e.what") == 0) & (next_start - F.col("end") <= reach)
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    events = events.withColumns({"by_identity": near("identity"), "by_secret": near("secret")})
    rows = events.groupBy("key", "kind", "nth").agg(
        F.first("carry", ignorenulls=True).alias("carry"), *[F.first(c).alias(c) for c in ("start", "end", "part")],
        F.bool_or("by_identity").alias("by_identity"), F.bool_or("by_secret").alias("by_secret"))
    kind = F.col("kind")
    linked = ((kind == names.index("blob")) & F.col("by_identity")) | ((kind == names.index("ident")) & F.col("by_secret")) | (
        (kind == names.index("endpoint")) & F.col("by_identity") & F.col("by_secret"))
    rows = rows.withColumn("told", F.col("part") & ((kind < len(BASE)) | linked))
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("told"), F.col("end"))).over(before), F.lit(0)))
    span = F.when(F.col("told"), F.struct("start", "kind", "end", "before"))
    out = rows.groupBy("key").agg(F.first("carry", ignorenulls=True).alias("carry"), F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select("carry", F.filter("spans", lambda s: s["kind"] < len(BASE)).alias("base"), "spans")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, reach: int = REACH, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every reported stretch of text replaced; n_chars, if there is one, follows a changed text."""
    out = scan(docs, reach, tuple(docs.columns)).select("carry.*", F.col("spans").alias("__spans"))
    text, spans = F.col("text"), F.col("__spans")
    kept = F.transform(spans, lambda s: F.when(s["start"] >= s["before"], F.concat(
        F.substring(text, s["before"] + 1, s["start"] - s["before"]), F.lit(placeholder))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.char_length(text)))
    out = out.withColumn("__clean", F.when(F.size(spans) > 0, clean))
    changed = {"text": F.coalesce("__clean", "text")}
    if "n_chars" in docs.columns:
        length = F.char_length("__clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(length, "n_chars")
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
