"""Print the physical plans of the headline queries (tree + scan details).

usage: python tools/plans.py [sf_dir] > PLANS.md
"""

import io
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, ".")
from wavespark.plans import catalog, viewing  # noqa: E402, F401
from wavespark.session import local_session  # noqa: E402

NAMES = ["linear_transform", "trace_stats", "power_multiply", "version_compare", "savgol_odd",
         "spectrum", "lowpass", "capture_ingest", "trace_stats_selected", "trace_divide", "derived_of_derived",
         "savgol_percent", "view_rows"]
KEEP = re.compile(r"^\(\d+\) (Scan|BroadcastHashJoin|SortMergeJoin|Exchange)|^(PushedFilters|PartitionFilters|"
                  r"ReadSchema|Arguments: (hashpartitioning|rangepartitioning|SinglePartition))")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on; the initial plan, before runtime "
          "re-optimisation).  Tree first, then the scan/exchange/join details.\n")
    for name in NAMES:
        df = catalog.QUERIES[name](spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree, _, details = text.partition("\n\n\n")
        keep = [ln for ln in details.splitlines() if KEEP.search(ln)]
        print(f"## {name}\n\n```text\n{tree.strip()}\n\n" + "\n".join(keep) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
