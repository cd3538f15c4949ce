"""Tour ingestion: a batch of point look-ups that is accepted as a whole or refused with every error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import edges as E
from factloom.operators import spans as S
from factloom.session import freeze

# Fixed value: the version of the tour form.
SCHEMA_VERSION = 1
REF = "struct<file: string, line: long>"
TOURS = f"tour string, schema_version int, title string, subject {REF}, steps array<struct<say: string, ref: {REF}, arrow: struct<`from`: {REF}, `to`: {REF}>>>"


@dataclass
class Checked:
    #: ``tour``, ``step`` (from 1; 0 is the tour itself), ``ref`` (1 or 2; 0 is the step itself), ``msg``
    errors: DataFrame
    #: ``tour``, ``step``, ``say``, ``focus`` (none, element, arrow), ``refs``; step 0 is the subject
    resolved: DataFrame


def first_files(spans: DataFrame) -> DataFrame:
    """``element_id`` and the first file in path order that holds it."""
    return spans.groupBy("element_id").agg(F.min("file").alias("file"))


def check(tours: DataFrame, spans: DataFrame, modules: DataFrame, directed: DataFrame, calls: DataFrame | None = None) -> Checked:
    """Check and resolve tours. A tour of another version or without steps has that error alone. A step has a reference,
    an arrow or neither; each reference resolves to an element or, without a line, to its file's module, and a file that
    is not indexed is an error; the ends of an arrow are different elements joined by an edge in its direction. Of a
    step the first error counts, of a tour all steps do. Tours with errors are not in ``resolved``."""
    head = F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), F.concat(F.lit("schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")), F.lit(f" not supported; expected {SCHEMA_VERSION}")))
    head = head.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, "tour has no steps")
    tours = tours.withColumn("_head", head)
    zero = F.lit(0)
    whole = tours.where("_head is not null").select("tour", zero.alias("step"), zero.alias("ref"), F.col("_head").alias("msg"))
    open_ = tours.where("_head is null")
    steps = open_.select("tour", F.posexplode("steps").alias("pos", "s")).select("tour", (F.col("pos") + 1).alias("step"), "s.say", F.col("s.ref").alias("one"), F.col("s.arrow.from").alias("a"), F.col("s.arrow.to").alias("b"), F.col("s.arrow").isNotNull().alias("is_arrow"))
    subject = open_.where("subject is not null").select("tour", zero.alias("step"), F.lit(None).cast("string").alias("say"), F.col("subject").alias("one"), F.lit(None).cast(REF).alias("a"), F.lit(None).cast(REF).alias("b"), F.lit(False).alias("is_arrow"))
    steps = freeze(steps.union(subject), "tour_steps")
    mixed = F.col("one").isNotNull() & F.col("is_arrow")

    asked = steps.where(~mixed).select("tour", "step", F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("ref"), F.col(c).alias("at"), F.lit(c).alias("slot")) for k, c in ((1, "one"), (1, "a"), (2, "b")))), lambda x: x["at"].isNotNull())).alias("x"))
    probes = asked.select(F.struct("tour", "step", "x.slot").alias("probe"), F.col("x.at.file").alias("file"), F.col("x.at.line").alias("line"))
    found = S.resolve_lines(probes, spans, calls, modules).select("probe.*", F.struct(F.col("element_id").alias("id"), F.when(F.col("how").isin("module", "unknown"), F.col("how")).otherwise("element").alias("kind"), "file").alias("r"))
    wide = freeze(found.groupBy("tour", "step").agg(*(F.max(F.when(F.col("slot") == c, F.col("r"))).alias(f"r_{c}") for c in ("one", "a", "b"))), "tour_refs")
    ends = F.col("r_a.id").isNotNull() & F.col("r_b.id").isNotNull()
    pairs = wide.where(ends).select(F.col("r_a.id").alias("from_id"), F.col("r_b.id").alias("to_id")).distinct()
    joined = E.edge_exists(pairs, directed.select("from_id", "to_id").distinct()).select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"), "exists", "reverse_exists")
    # only arrows with both ends are asked about; all other steps would meet under one null key
    hit = wide.where(ends).join(joined, (F.col("r_a.id") == F.col("_f")) & (F.col("r_b.id") == F.col("_t")), "left").drop("_f", "_t")
    rest = wide.where(~ends).withColumns({c: F.lit(None).cast("boolean") for c in ("exists", "reverse_exists")})
    j = steps.join(hit.unionByName(rest), ["tour", "step"], "left")

    lost = lambda c, said: F.concat(F.lit(f"{said}file not in index: "), F.coalesce(F.col(f"{c}.file"), F.lit("null")))
    error = lambda ref, msg: F.struct(F.lit(ref).alias("ref"), msg.alias("msg"))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    bad = F.when(mixed, error(0, F.lit("step sets both ref and arrow; pick one")))
    bad = bad.when(F.col("one").isNotNull() & F.col("r_one.id").isNull(), error(1, F.when(F.col("step") == 0, lost("one", "subject: ")).otherwise(lost("one", ""))))
    bad = bad.when(F.col("is_arrow") & F.col("r_a.id").isNull(), error(1, lost("a", "arrow.from: "))).when(F.col("is_arrow") & F.col("r_b.id").isNull(), error(2, lost("b", "arrow.to: ")))
    bad = bad.when(F.col("is_arrow") & (F.col("r_a.id") == F.col("r_b.id")), error(0, F.lit("both ends of the arrow are the same element")))
    bad = bad.when(F.col("is_arrow") & ~F.col("exists"), error(0, text("no edge from ", F.col("r_a.id"), " to ", F.col("r_b.id"), F.when(F.col("reverse_exists"), "; the reverse exists").otherwise(""))))
    judged = freeze(j.select("tour", "step", "say", "is_arrow", F.col("r_one").alias("one"), F.col("r_a").alias("a"), F.col("r_b").alias("b"), bad.alias("bad")), "judged_steps")

    of_subject = judged.where("bad is not null").select("tour", "step", F.when(F.col("step") == 0, 0).otherwise(F.col("bad.ref")).alias("ref"), "bad.msg")
    errors = freeze(whole.union(of_subject), "tour_errors")
    refs = F.filter(F.array("one", "a", "b"), lambda x: x.isNotNull())
    focus = F.when(F.col("is_arrow"), "arrow").when(F.col("one").isNotNull(), "element").otherwise("none")
    kept = judged.join(errors.select("tour").distinct(), "tour", "left_anti")
    return Checked(errors, kept.select("tour", "step", "say", focus.alias("focus"), F.transform(refs, lambda r: F.struct(r["id"].alias("id"), r["kind"].alias("kind"))).alias("refs")))


def ingest(checked: Checked, path: str) -> DataFrame:
    """Append the resolved tours in one write if there is no error at all; else write nothing. The errors."""
    if checked.errors.isEmpty():
        checked.resolved.write.mode("append").parquet(path)
    return checked.errors
