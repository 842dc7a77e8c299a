"""First rows of quote files that no task has as a whole."""

import gzip
from pathlib import Path

from tickloom.plans import queries as plans
from tickloom.sources import io

HEAD = "ticker,sequence_number\n"


def test_first_rows_follow_the_names_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "".join(f"O:A,{i}\n" for i in range(20)))
    (tmp_path / "b.csv").write_text(HEAD + "".join(f"O:A,{i}\n" for i in range(20, 5000)))
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(HEAD + "".join(f"O:A,{i}\n" for i in range(5000, 20000)))
    for n in (5, 50, 6000):
        assert [r.sequence_number for r in io.load_quotes(spark, str(tmp_path), rows=n).collect()] == list(range(n))
    assert [r.sequence_number for r in io.load_quotes(spark, str(tmp_path / "c.csv.gz"), rows=3).collect()] == [5000, 5001, 5002]
    with io.setting(spark, "spark.sql.files.maxPartitionBytes", "4000"):  # one file in many blocks
        assert [r.sequence_number for r in io.load_quotes(spark, str(tmp_path / "b.csv"), rows=1000).collect()] == list(range(20, 1020))


def test_no_task_sorts_the_whole_quote_file(spark):
    with io.setting(spark, "spark.sql.adaptive.enabled", "false"):
        folder = plans.quote_file(spark, "/root/testdata/sf0.001", None).removeprefix("file://")
    parts = [gzip.open(p, "rt").read().splitlines()[1:] for p in sorted(Path(folder).glob("part-*"))]
    found = [[int(line.split(",")[8]) for line in part] for part in parts]
    assert len(found) > 1 and max(map(len, found)) < 0.5 * sum(map(len, found))
    assert sum(found, []) == list(range(sum(map(len, found))))
