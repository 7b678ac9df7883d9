"""Fail-closed quality gates. A gate is a filter, a flag column or a report DataFrame; nothing is imputed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsengine.functions.expressions import all_finite, is_finite
from obsengine.operators.ranges import MOST, carried, same
from obsengine.operators.ranks import with_quantiles
from obsengine.operators.sizes import short


def complete_rows(df: DataFrame, required: Sequence[str], above: dict[str, float] | None = None) -> DataFrame:
    """Rows whose required columns are finite and, where a sentinel is given, above it."""
    return df.filter(all_finite(required, above))


def within_box(lon: str, lat: str, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive on every side; false for null."""
    return F.coalesce(F.col(lon).between(west, east) & F.col(lat).between(south, north), F.lit(False))


def require_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """df itself, or an error that names the missing and the forbidden columns."""
    missing, seen = sorted(set(required) - set(df.columns)), sorted(set(forbidden) & set(df.columns))
    if missing or seen:
        raise ValueError(f"missing columns: {missing}; forbidden columns: {seen}")
    return df


def forbidden_fields(df: DataFrame, forbidden: Sequence[str]) -> list[str]:
    """Paths of forbidden names anywhere in a nested schema."""
    names, found = {f.lower() for f in forbidden}, []

    def walk(kind, path):
        for field in getattr(kind, "fields", ()):
            at = f"{path}.{field.name}" if path else field.name
            found.extend([at] if field.name.lower() in names else [])
            walk(field.dataType, at)
        for inner in ("elementType", "valueType", "keyType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner), path)

    walk(df.schema, "")
    return found


def duplicate_status(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row a key: copies, versions (distinct contents of all other columns, null counting as a value), status."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.count("*").alias("copies"), F.count_distinct(F.struct(*rest)).alias("versions"))
    return out.withColumn("status", F.when(F.col("copies") == 1, "unique").when(F.col("versions") == 1, "identical").otherwise("conflicting"))


def resolve_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Identical copies become one row; conflicting copies fail the job."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.count_distinct(F.struct(*rest)).alias("__versions"), F.first(F.struct(*rest)).alias("__row"))
    conflict = F.raise_error(F.concat(F.lit("conflicting_duplicate_logical_opportunity: "), F.to_json(F.struct(*key)))).cast("boolean")
    return one.filter(F.when(F.col("__versions") > 1, conflict).otherwise(True)).select(*key, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def set_integrity(df: DataFrame, set_col: str, member_col: str, positive: Column, controls: int) -> DataFrame:
    """A row a set: members, positives, distinct members, and whether it is exactly 1 to `controls` without repeats."""
    out = df.groupBy(set_col).agg(F.count("*").alias("members"), F.sum(positive.cast("int")).cast("long").alias("positives"), F.count_distinct(member_col).alias("distinct_members"))
    exact = (F.col("members") == controls + 1) & (F.col("positives") == 1) & (F.col("distinct_members") == F.col("members"))
    return out.withColumn("exact", exact)


def drop_invalid_sets(df: DataFrame, set_col: str, invalid: Column) -> DataFrame:
    """Sets none of whose members is invalid. A null verdict counts as invalid."""
    bad = df.filter(F.coalesce(invalid, F.lit(True))).select(F.col(set_col).alias("__bad")).distinct()
    return df.join(bad, F.col(set_col).eqNullSafe(F.col("__bad")), "left_anti")


def exclusion_report(df: DataFrame, set_col: str, reasons: dict[str, Column]) -> DataFrame:
    """A row a set: a boolean a reason (some member has it; reasons don't exclude one another) and excluded."""
    flags = [F.bool_or(F.coalesce(c, F.lit(True))).alias(n) for n, c in reasons.items()]
    out = df.groupBy(set_col).agg(F.count("*").alias("members"), *flags)
    return out.withColumn("excluded", F.greatest(*[F.col(n) for n in reasons]) if len(reasons) > 1 else F.col(next(iter(reasons))))


def exclusion_counts(report: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """One row: sets, sets excluded, rows excluded, and sets by reason."""
    return report.agg(F.count("*").alias("sets"), F.count_if("excluded").alias("excluded_sets"), F.sum(F.when(F.col("excluded"), F.col("members")).otherwise(0)).alias("excluded_rows"), *[F.count_if(F.col(r)).alias(r) for r in reasons])


def looks_ahead(start: Column, event: Column, days: int = 16) -> Column:
    """The composite that starts at `start` isn't over before the event."""
    return ~(F.date_add(start, days) < event)


def support_reason(start: Column, end: Column, cutoff: Column) -> Column:
    """Why a support interval can't be used before a cutoff; null if it can."""
    return F.when(start.isNull() | end.isNull(), "support_missing").when(start > end, "support_reversed").when(end > cutoff, "support_after_cutoff")


def calendar(spark: SparkSession, first: Column | str, last: Column | str) -> DataFrame:
    """Every day from first to last (text or date literals)."""
    a, b = (F.to_date(F.lit(x)) if isinstance(x, str) else x for x in (first, last))
    return spark.range(1).select(F.explode(F.sequence(a, b)).alias("day"))


def calendar_coverage(days: DataFrame, expected: DataFrame, unit: Column, least: float = 0.8) -> DataFrame:
    """By unit of `expected` (a calendar of day): expected, supported, missing days, fraction, and whether it reaches least.

    days: observed day, repeats allowed. The observed days of a calendar are few; they are made distinct first."""
    seen = days.select("day").distinct().withColumn("__seen", F.lit(1))
    out = expected.join(seen, "day", "left").groupBy(unit.alias("unit")).agg(F.count("*").alias("expected_days"), F.count("__seen").alias("supported_days"))
    return out.withColumn("missing_days", F.col("expected_days") - F.col("supported_days")).withColumn("fraction", F.col("supported_days") / F.col("expected_days")).withColumn("supported", F.col("fraction") >= least)


def completeness(observed: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row a key of either side: status missing, extra, duplicate or present, and its count."""
    have = observed.groupBy(*key).agg(F.count("*").alias("n"))
    want = expected.select(*key).distinct().withColumn("__want", F.lit(True))
    out = have.join(want, list(key), "full_outer")
    n = F.coalesce("n", F.lit(0)).alias("n")
    return out.select(*key, n, F.when(F.col("n").isNull(), "missing").when(F.col("__want").isNull(), "extra").when(F.col("n") > 1, "duplicate").otherwise("present").alias("status"))


def gaps(df: DataFrame, group: Sequence[str], number: Column, most: int = 1) -> DataFrame:
    """Places where a group's sorted distinct numbers jump by more than `most`: before, after."""
    w = Window.partitionBy(*group).orderBy("after")
    steps = df.select(*group, number.alias("after")).distinct().withColumn("before", F.lag("after").over(w))
    return steps.filter(F.col("after") - F.col("before") > most).select(*group, "before", "after")


def composite_key(name: Column) -> Column:
    """Struct of year, doy and tile from a name of a 16-day composite (MOD13Q1.AYYYYDDD.hHHvVV.061....hdf); null if it doesn't fit."""
    pattern = r"^MOD13Q1\.A(\d{4})(\d{3})\.h(\d{2})v(\d{2})\.061\..+\.hdf$"
    year, doy, h, v = (F.regexp_extract(name, pattern, k) for k in range(1, 5))
    return F.when(name.rlike(pattern), F.struct(year.try_cast("int").alias("year"), doy.try_cast("int").alias("doy"), F.concat(F.lit("h"), h, F.lit("v"), v).alias("tile")))


def composite_calendar(spark: SparkSession, first_year: int, last_year: int, step: int = 16) -> DataFrame:
    """year, doy, day of composites that start every `step` days and anew each January 1."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    days = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(366), F.lit(step))).alias("doy"))
    return days.withColumn("day", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy") - 1)).filter(F.year("day") == F.col("year"))


def islands(df: DataFrame, group: Sequence[str], number: Column) -> DataFrame:
    """By group: distinct numbers, the first and last, and how many runs of consecutive numbers they form (1: contiguous). A run starts
    at each number whose predecessor isn't there."""
    seen = df.select(*group, number.alias("n")).filter("n is not null").distinct()
    before = seen.select(*[F.col(c).alias(f"__of_{c}") for c in group], (F.col("n") + 1).alias("__n"))
    starts = seen.join(before, same(group, "__of_") & (F.col("n") == F.col("__n")), "left").withColumn("start", F.col("__n").isNull())
    return starts.groupBy(*group).agg(F.count("*").alias("distinct_numbers"), F.min("n").alias("first"), F.max("n").alias("last"), F.count_if("start").alias("runs"))


def composite_completeness(names: DataFrame, name: str, first_year: int, last_year: int, step: int = 16) -> DataFrame:
    """A row a tile seen and composite of the calendar or of a name: n files, status missing, extra, duplicate or present. Names that
    don't fit have a row of status malformed with their number."""
    keyed = names.select(composite_key(F.col(name)).alias("k"))
    seen = keyed.filter("k is not null").select("k.tile", "k.year", "k.doy")
    calendar = composite_calendar(names.sparkSession, first_year, last_year, step).select("year", "doy")
    want = short(seen.select("tile").distinct()).crossJoin(short(calendar))  # the product of two short lists is what is asked for
    bad = keyed.filter("k is null").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("tile"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("doy"), "n", F.lit("malformed").alias("status"))
    return completeness(seen, want, ["tile", "year", "doy"]).unionByName(bad)


def archive_audit(files: DataFrame, manifest: DataFrame, step: int = 16, heads: Sequence[str] = ()) -> DataFrame:
    """One row of an archive of composites against its manifest: files, malformed names, distinct tiles and composites, tiles times
    composites without a file, runs of consecutive composites, files the manifest lacks and entries without a file, files of no
    bytes or of other first bytes than `heads` (hex), and status: complete if nothing is amiss, else needs_review.

    files: name, bytes, head. manifest: name."""
    one = files.withColumn("k", composite_key(F.col("name")))
    per_year = -(-366 // step)
    number = F.when((F.col("k.doy") - 1) % step == 0, F.col("k.year") * per_year + ((F.col("k.doy") - 1) / step).cast("int"))
    wrong = F.coalesce(F.col("bytes"), F.lit(0)) == 0
    if heads:
        wrong = wrong | ~F.coalesce(F.col("head").rlike(f"^({'|'.join(heads)})"), F.lit(False))
    seen = one.agg(
        F.count("*").alias("files"), F.count_if(F.col("k").isNull()).alias("malformed"), F.count_distinct("k.tile").alias("tiles"), F.count_distinct(F.when(F.col("k").isNotNull(), F.struct("k.year", "k.doy"))).alias("composites"),
        F.count_distinct(F.when(F.col("k").isNotNull(), F.col("k"))).alias("__pairs"), F.count_if(F.col("k").isNotNull() & number.isNull()).alias("off_calendar"), F.count_if(wrong).alias("bad_content"),
    )
    seen = seen.withColumn("holes", F.col("tiles") * F.col("composites") - F.col("__pairs")).drop("__pairs")
    runs = islands(one, [], number).select(F.col("runs"))
    listed = manifest.select("name").distinct()
    here = one.select("name").distinct()
    unlisted, absent = here.join(listed, "name", "left_anti").agg(F.count("*").alias("not_in_manifest")), listed.join(here, "name", "left_anti").agg(F.count("*").alias("not_in_archive"))
    out = seen.crossJoin(runs).crossJoin(unlisted).crossJoin(absent)  # one row each
    good = (F.col("files") > 0) & (F.col("malformed") + F.col("holes") + F.col("off_calendar") + F.col("bad_content") + F.col("not_in_manifest") + F.col("not_in_archive") == 0) & (F.col("runs") == 1)
    return out.withColumn("status", F.when(good, "complete").otherwise("needs_review"))


def fraction_audit(df: DataFrame, key: Sequence[str], values: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """One row: rows, repeated keys, values not finite, values outside 0..1."""
    repeats = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_keys"))
    finite = [is_finite(v) for v in values]
    odd = sum(((~f).cast("long") for f in finite), F.lit(0))
    out = sum(((f & ~F.col(v).between(-slack, 1 + slack)).cast("long") for f, v in zip(finite, values, strict=True)), F.lit(0))
    counts = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(odd), F.lit(0)).alias("not_finite"), F.coalesce(F.sum(out), F.lit(0)).alias("out_of_range"))
    return counts.crossJoin(repeats)  # one row each


def mass_balance(df: DataFrame, key: Sequence[str], whole: Column, part: Column, tolerance: float = 1e-8) -> DataFrame:
    """One row: keys, largest and 99th percentile of |whole - sum of parts|, and keys beyond the tolerance."""
    by = df.groupBy(*key).agg(F.abs(F.max(whole) - F.sum(part)).alias("residual"))
    out = by.agg(F.count("*").alias("keys"), F.max("residual").alias("max_residual"), F.count_if(F.col("residual") > tolerance).alias("violations"))
    return with_quantiles(out, by, [], F.col("residual"), {"p99_residual": 0.99}).select("keys", "max_residual", "p99_residual", "violations")


def conserved(sums: dict[str, DataFrame]) -> DataFrame:
    """Sums that must agree, each a one-row DataFrame of one number: name, value, agrees (all are equal)."""
    rows = None
    for name, df in sums.items():
        one = df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    every = Window.partitionBy()
    return rows.withColumn("agrees", F.max("value").over(every) == F.min("value").over(every))


def dense_grid_errors(df: DataFrame, axes: dict[str, DataFrame], count: str) -> DataFrame:
    """Pairs of the axes that are missing, extra, repeated, or whose count isn't a non-negative whole number."""
    want = None
    for name, values in axes.items():
        one = values.select(name).distinct()
        want = one if want is None else want.crossJoin(short(one))  # an axis is a short list of units
    bad = completeness(df, want, list(axes)).filter("status <> 'present'").select(*axes, "status")
    odd = df.filter(F.col(count).isNull() | (F.col(count) < 0) | (F.col(count) != F.floor(F.col(count)))).select(*axes, F.lit("bad_count").alias("status"))
    return bad.unionByName(odd)


def error_codes(rules: dict[str, Column]) -> Column:
    """Codes of the rules that a row breaks (a rule is true where broken; null counts as broken)."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def feature_gate(manifest: DataFrame, weights: dict[str, float], temporal: Sequence[str], causal: Sequence[str], least: float = 60.0) -> DataFrame:
    """Rules over a manifest of candidate features and negative controls: score 0 to 100, reasons to reject, verdict.

    Columns: name, scores (map of criterion to 0..5), available_before_prediction_cutoff, mathematical_component_of_target,
    shared_data_generation_with_target (a null counts against the feature), temporal_relation (one of temporal),
    minimum_lag_years (text or a number; a feature of the prior calendar year needs at least 1), causal_position (one of
    causal), provenance_url (https), license, required, negative_control. The last two are passed on and decide nothing: a
    negative control is judged like any feature, see feature_gate_report(). A score that is missing or out of range makes
    the whole score 0. Scores are rounded to two digits before they are compared."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights have to be positive")
    values = {k: F.element_at("scores", F.lit(k)) for k in weights}
    fit = F.lit(True)
    for v in values.values():
        fit = fit & F.coalesce(v.between(0, 5), F.lit(False))
    lag = F.col("minimum_lag_years").try_cast("double")
    score = F.round(sum((v * w for v, w in zip(values.values(), weights.values(), strict=True)), F.lit(0.0)) * 100 / (5 * sum(weights.values())), 2)
    out = manifest.withColumn("score", F.when(fit, score).otherwise(0.0))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reasons = error_codes({
        "missing_field": F.col("name").isNull() | F.col("causal_position").isNull() | F.col("temporal_relation").isNull() | F.col("scores").isNull(),
        "provenance_not_https": ~F.col("provenance_url").startswith("https://"), "no_license": blank(F.col("license")),
        "component_of_target": F.col("mathematical_component_of_target"), "shares_generation_with_target": F.col("shared_data_generation_with_target"),
        "temporal_relation_not_allowed": ~F.col("temporal_relation").isin(list(temporal)), "available_after_cutoff": ~F.col("available_before_prediction_cutoff"),
        "lag_not_numeric": lag.isNull(), "lag_too_short": F.coalesce((F.col("temporal_relation") == "prior_calendar_year") & (lag < 1), F.lit(False)),
        "causal_position_not_eligible": ~F.col("causal_position").isin(list(causal)), "bad_scores": ~fit, "low_score": F.col("score") < least,
    })
    return out.withColumn("reasons", reasons).select("name", "required", "negative_control", "score", "reasons", (F.size("reasons") == 0).alias("accepted"))


def feature_gate_report(decisions: DataFrame) -> DataFrame:
    """One row on feature_gate(): candidates, accepted ones, required ones that were rejected, negative controls, those that the
    rules let pass, and whether all is ready: no required feature rejected, every negative control caught."""
    control = F.coalesce(F.col("negative_control"), F.lit(False))
    lost = ~control & F.coalesce(F.col("required"), F.lit(False)) & ~F.col("accepted")
    out = decisions.agg(F.count_if(~control).alias("candidates"), F.count_if(~control & F.col("accepted")).alias("accepted"), F.count_if(lost).alias("required_rejections"), F.count_if(control).alias("negative_controls"), F.count_if(control & F.col("accepted")).alias("negative_controls_missed"))
    return out.withColumn("ready", (F.col("required_rejections") == 0) & (F.col("negative_controls_missed") == 0))


def entry_hash(sequence: Column, previous: Column, payload: Column) -> Column:
    """sha256 of an entry's number, its predecessor's hash (empty for the first) and its payload, a line each."""
    return F.sha2(F.concat_ws("\n", sequence.cast("string"), F.coalesce(previous, F.lit("")), F.coalesce(payload, F.lit(""))), 256)


def hash_chain(df: DataFrame, log: Sequence[str], sequence: str, payload: Column) -> DataFrame:
    """df with previous_hash and entry_hash: each entry's hash covers its number, its payload and the hash before it.

    A chain is made one entry after the other; logs are dealt to tasks, and a task streams its entries in order and carries
    one hash, so no log is held in memory."""
    from hashlib import sha256

    import pyarrow as pa

    names = list(log)
    rows = df.withColumn("__log", F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).withColumn("__text", F.concat(F.lit("\n"), F.coalesce(payload, F.lit("")))).withColumn("__number", F.col(sequence).cast("string"))
    rows = rows.repartition("__log").sortWithinPartitions("__log", sequence)
    width = len(df.columns)

    def run(batches):
        last = (None, None)
        for batch in batches:
            before, own = [], []
            for key, text, number in zip(*(batch.column(width + k).to_pylist() for k in range(3)), strict=True):
                previous = last[1] if last[0] == key else None
                last = key, sha256(f"{number}\n{previous or ''}{text}".encode()).hexdigest()
                before.append(previous)
                own.append(last[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names[:width], "previous_hash", "entry_hash"])

    return rows.mapInArrow(run, df.withColumn("previous_hash", F.lit(None).cast("string")).withColumn("entry_hash", F.lit(None).cast("string")).schema)


def verify_chain(df: DataFrame, log: Sequence[str], sequence: str, payload: Column, entry: str = "entry_hash", previous: str = "previous_hash", most: int | None = MOST) -> DataFrame:
    """Rows that break a log: sequence_gap (numbers count from 1), broken_predecessor_link or entry_tampered, as an array of codes.

    Unlike making a chain, this needs no order of work: each entry is held against the one before it, and a log of over `most`
    entries is cut into ranges of numbers, so that all tasks verify it."""
    out = carried(df, log, [sequence], {"__last": F.struct(F.col(sequence).alias("number"), F.col(entry).alias("hash"))}, most=most)
    out = out.withColumn("__before", F.col("__last")["hash"]).withColumn("__seq", F.coalesce(F.col("__last")["number"], F.lit(0)))
    codes = error_codes({
        "sequence_gap": F.col(sequence) != F.col("__seq") + 1,
        "broken_predecessor_link": ~F.col(previous).eqNullSafe(F.col("__before")),
        "entry_tampered": ~F.col(entry).eqNullSafe(entry_hash(F.col(sequence), F.col(previous), payload)),
    })
    return out.withColumn("errors", codes).filter(F.size("errors") > 0).drop("__last", "__before", "__seq")


def reconcile(local: DataFrame, recorded: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Both inventories by key: recorded, changed, not_recorded or not_retained."""
    a, b = local.select(*key, F.col(value).alias("local_value")).withColumn("__l", F.lit(1)), recorded.select(*key, F.col(value).alias("recorded_value")).withColumn("__r", F.lit(1))
    out = a.join(b, list(key), "full_outer")
    status = F.when(F.col("__l").isNull(), "not_retained").when(F.col("__r").isNull(), "not_recorded").when(F.col("local_value").eqNullSafe(F.col("recorded_value")), "recorded").otherwise("changed")
    return out.select(*key, "local_value", "recorded_value", status.alias("status"))


def frame_audit(df: DataFrame, key: Sequence[str], status: str, valid: str, rules: dict[str, Column]) -> DataFrame:
    """By status: rows, valid rows, and rows that break each rule (null counts as broken)."""
    return df.groupBy(status).agg(F.count("*").alias("rows"), F.count_if(F.col(valid)).alias("valid_rows"), F.count_distinct(*key).alias("distinct_keys"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])


def hourly_audit(df: DataFrame, ts: str, variables: Sequence[str], extent: tuple[str, str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """By month of a timestamp: hours expected and distinct hours found, first and last stamp, nulls, complete.

    extent: columns of latitude and longitude; box: south, north, west, east. With them also the extent found, covers_box
    (it reaches each side), rows outside the box, and complete asks for the first."""
    month = F.trunc(F.col(ts).cast("date"), "month")
    found = [f(c).alias(n) for c, names in zip(extent, (("south", "north"), ("west", "east")), strict=True) for f, n in zip((F.min, F.max), names, strict=True)] if extent else []
    inside = F.col(extent[0]).between(*box[:2]) & F.col(extent[1]).between(*box[2:]) if extent else None
    outside = [F.count_if(~F.coalesce(inside, F.lit(False))).alias("rows_outside")] if extent else []
    out = df.groupBy(month.alias("month")).agg(F.count_distinct(F.date_trunc("hour", ts)).alias("hours"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(sum((F.col(v).isNull().cast("long") for v in variables), F.lit(0))).alias("missing_values"), *found, *outside)
    want = F.dayofmonth(F.last_day("month")) * 24
    complete = (F.col("hours") == want) & (F.col("missing_values") == 0)
    out = out.withColumn("expected_hours", want)
    if extent:
        covers = (F.col("south") <= box[0]) & (F.col("north") >= box[1]) & (F.col("west") <= box[2]) & (F.col("east") >= box[3])
        out = out.withColumn("covers_box", F.coalesce(covers, F.lit(False)))
        complete = complete & F.col("covers_box")
    return out.withColumn("complete", complete)


def asset_gate(manifest: DataFrame, inventory: DataFrame, receipts: DataFrame) -> DataFrame:
    """A row an asset: file found, hash equal to its receipt's, no repeats, provenance given; gate_ready if all hold.

    manifest: asset, path. inventory: path, sha256. receipts: asset, sha256, provenance_url."""
    files = inventory.groupBy("path").agg(F.count("*").alias("files"), F.min("sha256").alias("file_sha256"))
    papers = receipts.groupBy("asset").agg(F.count("*").alias("receipts"), F.min("sha256").alias("receipt_sha256"), F.min(F.trim("provenance_url")).alias("url"))
    out = manifest.join(files, "path", "left").join(papers, "asset", "left")
    checks = {"file_found": F.coalesce(F.col("files") == 1, F.lit(False)), "receipt_found": F.coalesce(F.col("receipts") == 1, F.lit(False)), "hash_matches": F.coalesce(F.col("file_sha256") == F.col("receipt_sha256"), F.lit(False)), "provenance_given": F.coalesce(F.col("url") != "", F.lit(False))}
    for n, c in checks.items():
        out = out.withColumn(n, c)
    ready = F.col("file_found") & F.col("receipt_found") & F.col("hash_matches") & F.col("provenance_given")
    return out.select("asset", *checks, ready.alias("gate_ready"))
