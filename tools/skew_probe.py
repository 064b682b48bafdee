"""Hot-key measurement: one key holds a third of the rows (lineitem at the given sf).

Usage: python tools/skew_probe.py [sf_dir].  Times the lagged features with the
per-key plan and with the segmented plan, and checks both give the same rows.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import windows as win  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources.tables import read_table  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16)
    li = read_table(spark, sf_dir, "lineitem", spread=True)
    df = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("k"),
                   "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    res = {}
    for strategy in ("key", "segmented"):
        out = win.lagged_features(df, ["k"], order, ["l_extendedprice", "l_discount"], strategy=strategy)
        out.write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        res[strategy] = round(time.perf_counter() - t0, 2)
    a = win.lagged_features(df, ["k"], order, ["l_extendedprice"], strategy="key")
    b = win.lagged_features(df, ["k"], order, ["l_extendedprice"], strategy="segmented")
    cols = ["l_extendedprice_roll3", "l_extendedprice_ewm5"]
    diff = a.select("k", *order, *[F.round(c, 6).alias(c) for c in cols]).exceptAll(
        b.select("k", *order, *[F.round(c, 6).alias(c) for c in cols])).count()
    print({"hot_key_rows": df.filter("k = -1").count(), "rows": df.count(), **res, "differing_rows": diff})


if __name__ == "__main__":
    main()
