"""Write PLANS.md: the physical plan trees of the main operators.

    python tools/plans.py [sf_dir]

Only the operator tree of ``explain("formatted")`` is kept (the per-node
details are long); the text under each tree says what to look for.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from riskvq.operators import evaluate as E  # noqa: E402
from riskvq.operators import sampling as S  # noqa: E402
from riskvq.operators.bvq import _bvq_kernel  # noqa: E402
from riskvq.operators.codebook import Codebook  # noqa: E402
from riskvq.operators.nearest import PARTIAL_SCHEMA, assign_nearest, predict  # noqa: E402
from riskvq.operators.ranking import with_position  # noqa: E402
from riskvq.operators.som import _som_kernel  # noqa: E402
from riskvq.session import get_spark  # noqa: E402
from riskvq.sources.labeled import events_labeled, lineitem_labeled  # noqa: E402


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    lines = []
    for line in text.splitlines()[1:]:
        if not line.strip():
            break
        lines.append(line)
    return "\n".join(lines)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    li = lineitem_labeled(spark, sf)
    ev = events_labeled(spark, sf)
    train, test = S.train_test(S.split_random(li, 80, 15))
    cb = Codebook.from_df(S.init_codebook_per_class(train, {0: 3, 1: 7, 2: 5}, 15))
    def totals(kernel, *columns):
        partials = train.select(*columns).mapInArrow(kernel, PARTIAL_SCHEMA)
        return partials.groupBy("code_id").agg(F.sum("n"), F.sum("s"), *[F.sum(F.get("v", F.lit(d))) for d in range(cb.dims)])

    per_code = totals(_som_kernel(cb, False), "features")
    bvq_sums = totals(_bvq_kernel(cb, 0.01, 0.1, None, "sample"), "features", "label")
    cases = [
        ("Nearest code (M1), Arrow path",
         assign_nearest(li, cb),
         "Scan -> projection -> MapInArrow. No Exchange: scoring is map-only, the codebook travels in "
         "the kernel's closure."),
        ("Predict the test part and count the confusion matrix (M7 + E1)",
         E.confusion(predict(test, cb)),
         "The keyed split is a Filter on the scan; the only Exchange carries partial counts "
         "(at most classes^2 rows per task)."),
        ("SOM pass (M2): nearest code, then per-code sums",
         per_code,
         "One kernel finds the nearest code and sums per code: MapInArrow puts out at most K rows a task, whatever the "
         "skew, and no feature comes back from Python."),
        ("BVQ pass (M5): contributions and per-code sums",
         bvq_sums,
         "One kernel: two nearest codes, window test, update and sums per code; at most K rows a task leave it."),
        ("Keyed random split (SP8)",
         S.split_random(ev, 80, 15),
         "A projection over the scan: no shuffle."),
        ("Positional split by id (SP7)",
         S.split_by_position(ev, 80),
         "After the id cutoff is found from the id column alone, the split is a projection: no shuffle."),
        ("Per-class codebook draw (SP6)",
         S.init_codebook_per_class(train, {0: 3, 1: 7, 2: 5}, 15),
         "The key threshold of each class is a Filter on the scan; a per-task WindowGroupLimit before the Exchange."),
        ("Global position (SP9, T1, T2)",
         with_position(ev, ["label", "id"]),
         "One Exchange of the rows by range, numbered by a window in each; bounds and offsets are literals."),
        ("Class profile (E7)",
         E.class_profile(li, 4),
         "One HashAggregate with 4 x D partial aggregates; the scan reads the label and feature columns "
         "only."),
    ]
    out = ["# PLANS", "", f"Physical plan trees (`explain(\"formatted\")`, operator tree only) at `{sf}`,",
           "generated by `python tools/plans.py`. AQE may re-plan at run time (e.g. coalesce partitions).", ""]
    for title, df, note in cases:
        out += [f"## {title}", "", "```", tree(df), "```", "", note, ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print("wrote", path)
    spark.stop()


if __name__ == "__main__":
    main()
