"""Leakage-safe lagged features per key (the heart of the engine).

Every feature of a row uses strictly earlier rows of the same key: frames end
at -1, so no ``lag`` is needed.  All expressions sharing one (partition, order)
spec land in one Window node; the only exchange is the hash partitioning on
the key, which the (key, segment) windows reuse.

Exponentially weighted mean (pandas ``ewm(span, adjust=True, ignore_na=False,
min_periods=1)`` of the shifted series) is computed exactly and without
overflow for keys of any length:

* the EWM value at an observed row m is E_m = sum_k x_k q^(m-k) / sum_k q^(m-k)
  over observed k <= m (q = 1 - 2/(span+1));
* at a missing row the shifted EWM carries the value of the last observation,
  so the feature of row n is ``last(E_m, ignorenulls)`` over rows before n;
* E_m is evaluated with segment-relative weights: rows are cut into segments
  of S rows (S = ceil(60 / -ln q)); inside segment s the running sums use
  q^-(k - sS) (< e^60, no overflow) and the previous segment enters with the
  factor q^S.  Older segments weigh less than e^-60 relative to the current
  row and are below double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import col_

# Fixed values that define the reference semantics.
ROLL_WINDOWS = (3, 5)
EWM_SPANS = (3, 5)
STARTED_MINUTES = 45
MINUTES_PER_MATCH = 90.0
SUB_RISK_WINDOW = 5

def ewm_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def ewm_segment(spans: Sequence[float]) -> int:
    qs = [ewm_decay(s) for s in spans]
    seg = max(1, math.ceil(60.0 / -math.log(max(qs))))
    if -math.log(min(qs)) * seg > 600:  # q^-S must stay far from overflow
        raise ValueError(f"spans {spans} too far apart for one segment length")
    return seg


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _order_sql(order: Sequence[str]) -> str:
    """Missing order values come last, so an undated row is never another row's past."""
    return ", ".join(f"{_q(o)} ASC NULLS LAST" for o in order)


def _order_struct(order: Sequence) -> Column:
    return F.struct(*[x for o in order for x in (col_(o).isNull(), col_(o))])


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a missing value meets a missing value; ``cols`` once, from the left."""
    renamed = right.select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate(cols)],
                           *[c for c in right.columns if c not in cols])
    on = " AND ".join(f"{_q(c)} <=> __j{i}" for i, c in enumerate(cols))
    return left.join(renamed, F.expr(on), how).drop(*[f"__j{i}" for i in range(len(cols))])


def lagged_features(df: DataFrame, key: Sequence[str], order: Sequence[str],
                    measures: Iterable[str], windows: Sequence[int] = ROLL_WINDOWS,
                    spans: Sequence[float] = EWM_SPANS, prefix: str = "",
                    roll_only: Sequence[str] = (), sub_risk: str | None = None,
                    corrected: bool = False, strategy: str | None = None) -> DataFrame:
    """Add ``{prefix}{m}_roll{w}`` and ``{prefix}{m}_ewm{s}`` for each present measure.

    ``strategy`` (default: conf ``tessera.window.strategy``, else "key"): "key"
    puts the rows of a key into one window partition; "segmented" splits a key
    into pieces, for keys that may hold a large share of all rows.  Both give
    the same answer.  Rows are in ``order`` with missing values last.

    Measures absent from ``df`` are skipped silently.  ``roll_only`` columns get
    the rolling means only; ``sub_risk`` names a 0/1 started column from which
    the reference's sub-risk share is derived.  The expressions are emitted as
    SQL text (one JVM call per projection) and all share the key partitioning:
    one exchange, one sort on (key, order) and one on (key, segment, row).
    """
    key, order = list(key), list(order)
    strategy = strategy or df.sparkSession.conf.get("tessera.window.strategy", "key")
    if strategy not in ("key", "segmented"):
        raise ValueError(f"unknown window strategy {strategy!r}")
    if strategy == "segmented":
        return lagged_features_segmented(df, key, order, measures, windows, spans, prefix,
                                         roll_only, sub_risk, corrected)
    cols = df.columns
    measures = [m for m in measures if m in cols]
    roll_only = [m for m in roll_only if m in cols and m not in measures]
    K = ", ".join(_q(k) for k in key)
    O = _order_sql(order)
    seg_len = ewm_segment(spans) if (spans and measures) else 1
    out = df.selectExpr("*", f"row_number() OVER (PARTITION BY {K} ORDER BY {O}) - 1 AS __rn") \
            .selectExpr("*", f"floor(__rn / {seg_len}) AS __seg")
    # sorted here, while rows are narrow: all windows below find them in this order
    out = out.sortWithinPartitions(*[F.col(_q(k)) for k in key], "__seg", "__rn")

    seg_w = f"PARTITION BY {K}, __seg ORDER BY __rn"
    row_w = f"PARTITION BY {K} ORDER BY __seg, __rn"
    past = lambda lo: f"OVER ({row_w} ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING)"
    all_past = f"OVER ({row_w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    tags = [(m, s, f"{m}_{s}".replace("`", "")) for m in measures for s in spans]
    if tags:
        run = f"OVER ({seg_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        sums, ewm = [], []
        for m, s, t in tags:
            x, rel = f"CAST({_q(m)} AS DOUBLE)", f"pow({ewm_decay(s)!r}D, -(__rn - __seg * {seg_len}))"
            sums += [f"sum({x} * {rel}) {run} AS `__a_{t}`", f"sum(CASE WHEN {x} IS NOT NULL THEN {rel} END) {run} AS `__b_{t}`"]
            qs = f"{ewm_decay(s) ** seg_len!r}D"
            num, den = (f"({qs} * coalesce(__p.`{c}_{t}`, 0D) + `__{c}_{t}`)" for c in "ab")
            ewm.append(f"CASE WHEN {_q(m)} IS NOT NULL THEN {num} / {den} END AS `__e_{t}`")
        # at a segment's end the running sums are the segment's, 0 if it has no value; the previous segment's are one
        # value to carry, and NULL in all keys of one segment, instead of a column for each sum
        ends = ", ".join(f"'{c}_{t}', coalesce(`__{c}_{t}`, 0D)" for _, _, t in tags for c in "ab")
        out = out.selectExpr("*", *sums).selectExpr(
            "*", f"CASE WHEN __rn % {seg_len} = {seg_len - 1} THEN named_struct({ends}) END AS __end")
        out = out.selectExpr("*", f"last(__end, true) {all_past} AS __p")
        out = out.selectExpr(*[_q(c) for c in cols], "__rn", "__seg", *ewm)

    new_cols, exprs = [], []
    for m in measures + roll_only:
        for w in windows:
            name = f"{prefix}{m}_roll{w}"
            exprs.append(f"avg(CAST({_q(m)} AS DOUBLE)) {past(w)} AS {_q(name)}")
            new_cols.append(name)
    if sub_risk:
        ns = f"CAST({_q(sub_risk)} < 1 AS DOUBLE)"
        if corrected:
            exprs.append(f"avg({ns}) {past(SUB_RISK_WINDOW)} AS sub_risk")
        else:
            exprs.append(f"CASE WHEN __rn > 0 THEN sum({ns}) {past(SUB_RISK_WINDOW)} "
                         f"/ least({SUB_RISK_WINDOW}, __rn + 1) END AS sub_risk")
        new_cols.append("sub_risk")
    for m, s, t in tags:
        exprs.append(f"last(`__e_{t}`, true) {all_past} AS {_q(f'{prefix}{m}_ewm{s}')}")
        new_cols.append(f"{prefix}{m}_ewm{s}")
    if exprs:
        out = out.selectExpr("*", *exprs)
    return out.selectExpr(*[_q(c) for c in cols], *[_q(c) for c in dict.fromkeys(new_cols)])


def minutes_features(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     minutes: str = "minutes", windows: Sequence[int] = ROLL_WINDOWS,
                     corrected: bool = False, measures: Iterable[str] = (),
                     spans: Sequence[float] = EWM_SPANS, strategy: str | None = None) -> DataFrame:
    """started, minutes_pct, their lagged means and sub_risk (plus optional
    measure rolls/EWMs) in the same Window nodes.

    ``sub_risk`` keeps the reference quirk: the missing value created by the
    shift stays inside the size-5 window and counts in the denominator, so it is
    sum(not started over the last 5 rows) / least(5, row_number); NULL for the
    first row.  ``corrected=True`` uses the plain mean instead.
    """
    m = _q(minutes)
    out = df.selectExpr("*", f"CAST(coalesce(CAST({m} AS DOUBLE) >= {STARTED_MINUTES}, false) AS DOUBLE) AS started",
                        f"CAST({m} AS DOUBLE) / {MINUTES_PER_MATCH} AS minutes_pct")
    return lagged_features(out, key, order, measures, windows, spans,
                           roll_only=("started", "minutes_pct"), sub_risk="started", corrected=corrected,
                           strategy=strategy)


def last_state(df: DataFrame, key: Sequence[str], order: Sequence, columns: Sequence[str],
               numbered: bool | str = False) -> DataFrame:
    """Per key and per column the last non-missing value by ``order``.

    An aggregate (partial aggregation before the shuffle), not a window: a hot
    key is pre-reduced on every map task.  ``numbered`` is for rows that a window
    has brought together by key before: they are numbered in ``order`` there, and
    the aggregate compares and keeps numbers instead of structs, one a column; a name says which column has
    such numbers already.
    """
    columns = list(dict.fromkeys(c for c in columns if c not in key))
    if isinstance(numbered, str):
        df = df.select(*key, *columns, F.col(numbered).alias("__order"))
    elif numbered:
        w = Window.partitionBy(*key).orderBy(*[F.col(_q(o)).asc_nulls_last() for o in order])
        df = df.select(*df.columns, F.row_number().over(w).alias("__order"))
    else:  # made once a row, not once for every column
        df = df.select(*key, *columns, _order_struct(order).alias("__order"))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c) for c in columns]
    return df.groupBy(*key).agg(*aggs)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (a total order).

    Expressed as ``max_by`` over a struct of the row, so map-side partial
    aggregation bounds what a hot key sends through the shuffle.
    """
    others = [c for c in df.columns if c not in key]
    ord_struct = _order_struct(order)
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*others), ord_struct).alias("__row"))
    return picked.select(*key, *[F.col("__row")[c].alias(c) for c in others])



def lagged_features_segmented(df: DataFrame, key: Sequence[str], order: Sequence[str],
                              measures: Iterable[str], windows: Sequence[int] = ROLL_WINDOWS,
                              spans: Sequence[float] = EWM_SPANS, prefix: str = "",
                              roll_only: Sequence[str] = (), sub_risk: str | None = None,
                              corrected: bool = False, super_block: int = 1024) -> DataFrame:
    """Same output as ``lagged_features`` without a single-task partition per key.

    For keys that may hold a large share of all rows.  The first order column
    (its day, if it is a time) splits a key into chunks, so chunks are in order;
    it should be coarse, such as a period or a time:

    1. row numbers: per-(key, chunk) counts -> offsets by a running sum over
       the small count table -> ``offset + row_number()`` within (key, chunk);
    2. rows are cut into segments of S rows; each row is processed in its own
       segment, and the last H rows of a segment are also copied as a halo
       into the next one (H = the longest row frame), so bounded frames are exact;
    3. EWM: per-segment sums (S times fewer rows than the data) give the
       previous segment's contribution (an equi-join on segment + 1) and the
       value carried over segments without observations (forward fill inside
       blocks of ``super_block`` segments, then over the block table, which is
       S x super_block times smaller than the data); joined back on (key, segment).

    Full-data shuffles are on (key, chunk) and (key, segment): balanced as long
    as a single (key, chunk) is not itself huge.
    """
    key, order = list(key), list(order)
    cols = df.columns
    measures = [m for m in measures if m in cols]
    roll_only = [m for m in roll_only if m in cols and m not in measures]
    K = ", ".join(_q(k) for k in key)
    O = _order_sql(order)
    first_is_time = df.schema[order[0]].dataType.typeName().startswith("timestamp")
    chunk = f"date_trunc('DAY', {_q(order[0])})" if first_is_time else _q(order[0])
    S = ewm_segment(spans) if (spans and measures) else 1024
    H = max(list(windows) + ([SUB_RISK_WINDOW] if sub_risk else []) + [1])
    S = max(S, H)

    base = df.selectExpr("*", f"{chunk} AS __chunk")
    counts = base.groupBy(*key, "__chunk").count()
    offs = counts.selectExpr(*[_q(k) for k in key], "__chunk",
                             f"coalesce(sum(`count`) OVER (PARTITION BY {K} ORDER BY __chunk ASC NULLS LAST "
                             f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __off")
    r = _join_on(base, offs, key + ["__chunk"], "inner")
    r = r.selectExpr("*", f"__off + row_number() OVER (PARTITION BY {K}, __chunk ORDER BY {O}) - 1 AS __rn") \
         .selectExpr("*", f"floor(__rn / {S}) AS __seg").drop("__chunk", "__off")

    # per-segment EWM sums (segment-relative weights), prev-segment sums and carry
    summ_aggs = []
    for m in measures:
        x = f"CAST({_q(m)} AS DOUBLE)"
        for s in spans:
            t = f"{m}_{s}".replace("`", "")
            rel = f"pow({ewm_decay(s)!r}D, -(__rn - __seg * {S}))"
            summ_aggs += [f"sum({x} * {rel}) AS `__at_{t}`", f"sum(CASE WHEN {x} IS NOT NULL THEN {rel} END) AS `__bt_{t}`"]
    summary = None
    if summ_aggs:
        tags = [(f"{m}_{s}".replace("`", ""), s) for m in measures for s in spans]
        sums = r.groupBy(*key, "__seg").agg(*[F.expr(e) for e in summ_aggs])
        # previous segment's sums: an equi-join on (key, seg + 1), not a per-key window
        prev = sums.selectExpr(*[_q(k) for k in key], "__seg + 1 AS __seg",
                               *[f"`__at_{t}` AS `__pa_{t}`" for t, _ in tags],
                               *[f"`__bt_{t}` AS `__pb_{t}`" for t, _ in tags])
        summary = _join_on(sums, prev, key + ["__seg"], "left")
        last_e = []
        for t, s in tags:
            qs = f"{ewm_decay(s) ** S!r}D"
            last_e.append(f"CASE WHEN `__bt_{t}` IS NOT NULL THEN ({qs} * coalesce(`__pa_{t}`, 0D) + `__at_{t}`)"
                          f" / ({qs} * coalesce(`__pb_{t}`, 0D) + `__bt_{t}`) END AS `__le_{t}`")
        summary = summary.selectExpr("*", *last_e, f"floor(__seg / {super_block}) AS __sb")
        # carried value = last segment value before this segment, in two levels:
        # inside blocks of `super_block` segments, then across the (much smaller) block table
        sbw = f"OVER (PARTITION BY {K}, __sb ORDER BY __seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        summary = summary.selectExpr("*", *[f"last(`__le_{t}`, true) {sbw} AS `__lc_{t}`" for t, _ in tags])
        blocks = summary.groupBy(*key, "__sb").agg(
            *[F.max_by(F.col(f"__le_{t}"), F.when(F.col(f"__le_{t}").isNotNull(), F.col("__seg"))).alias(f"__bl_{t}")
              for t, _ in tags])
        bw = f"OVER (PARTITION BY {K} ORDER BY __sb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        blocks = blocks.selectExpr(*[_q(k) for k in key], "__sb", *[f"last(`__bl_{t}`, true) {bw} AS `__bc_{t}`"
                                                                   for t, _ in tags])
        summary = _join_on(summary, blocks, key + ["__sb"], "left").selectExpr(
            *[_q(k) for k in key], "__seg AS __part",
            *[f"`__p{p}_{t}`" for t, _ in tags for p in ("a", "b")],
            *[f"coalesce(`__lc_{t}`, `__bc_{t}`) AS `__c_{t}`" for t, _ in tags])

    own = r.selectExpr("*", "__seg AS __part", "false AS __halo")
    halo = r.filter(f"__rn % {S} >= {S - H}").selectExpr("*", "__seg + 1 AS __part", "true AS __halo")
    u = own.unionByName(halo)
    if summary is not None:
        u = _join_on(u, summary, key + ["__part"], "left")

    pw = f"PARTITION BY {K}, __part ORDER BY __rn"
    past = lambda lo: f"OVER ({pw} ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING)"
    run = f"OVER ({pw} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    new_cols, exprs, tmp = [], [], []
    for m in measures + roll_only:
        for w in windows:
            name = f"{prefix}{m}_roll{w}"
            exprs.append(f"avg(CAST({_q(m)} AS DOUBLE)) {past(w)} AS {_q(name)}")
            new_cols.append(name)
    if sub_risk:
        ns = f"CAST({_q(sub_risk)} < 1 AS DOUBLE)"
        if corrected:
            exprs.append(f"avg({ns}) {past(SUB_RISK_WINDOW)} AS sub_risk")
        else:
            exprs.append(f"CASE WHEN __rn > 0 THEN sum({ns}) {past(SUB_RISK_WINDOW)} "
                         f"/ least({SUB_RISK_WINDOW}, __rn + 1) END AS sub_risk")
        new_cols.append("sub_risk")
    for m in measures:
        x = f"CAST({_q(m)} AS DOUBLE)"
        for s in spans:
            t = f"{m}_{s}".replace("`", "")
            rel = f"pow({ewm_decay(s)!r}D, -(__rn - __part * {S}))"
            exprs += [f"sum(CASE WHEN NOT __halo THEN {x} * {rel} END) {run} AS `__a_{t}`",
                      f"sum(CASE WHEN NOT __halo AND {x} IS NOT NULL THEN {rel} END) {run} AS `__b_{t}`"]
            tmp += [f"__a_{t}", f"__b_{t}"]
    out = u.selectExpr("*", *exprs)
    ewm = []
    for m in measures:
        for s in spans:
            t = f"{m}_{s}".replace("`", "")
            qs = f"{ewm_decay(s) ** S!r}D"
            e = (f"CASE WHEN NOT __halo AND {_q(m)} IS NOT NULL THEN ({qs} * coalesce(`__pa_{t}`, 0D) + `__a_{t}`)"
                 f" / ({qs} * coalesce(`__pb_{t}`, 0D) + `__b_{t}`) END")
            name = f"{prefix}{m}_ewm{s}"
            ewm.append(f"coalesce(last({e}, true) {past('UNBOUNDED')}, `__c_{t}`) AS {_q(name)}")
            new_cols.append(name)
    if ewm:
        out = out.selectExpr("*", *ewm)
    out = out.filter("NOT __halo")
    return out.selectExpr(*[_q(c) for c in cols], *[_q(c) for c in dict.fromkeys(new_cols)])


def period_strict(df: DataFrame, key: Sequence[str], period: str, order: Sequence[str],
                  cols: Sequence[str]) -> DataFrame:
    """Option strict="period": a row sees only rows of earlier periods.

    The row-strict feature of the first row of a (key, period) group is built
    from exactly the rows of earlier periods, so every row of the group takes
    that value (``first`` over the group: the key's partitioning is reused).
    """
    K = ", ".join(_q(k) for k in key)
    O = _order_sql(order)
    w = f"OVER (PARTITION BY {K}, {_q(period)} ORDER BY {O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    repl = {c: f"first({_q(c)}) {w} AS {_q(c)}" for c in cols}
    return df.selectExpr(*[repl.get(c, _q(c)) for c in df.columns])
