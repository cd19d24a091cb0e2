import subprocess
import sys
from pathlib import Path

from varloom.sources.sinks import write_tsv
from varloom.streaming import harmonize_stream as hs

ROOT = Path(__file__).resolve().parents[1]


def test_files_as_they_arrive(spark, tmp_path):
    rows = [("rs1", "1", 100, "a", "g", 5.0, 1.0), ("rs2", "6", 30_000_000, "a", "g", 5.0, 1.0), ("rs3", "X", 5, "a", "g", 5.0, 1.0)]
    for i in range(2):
        write_tsv(spark.createDataFrame([(f"{r[0]}_{i}", *r[1:]) for r in rows], "SNP string, CHR string, BP long, A1 string, A2 string, N double, Z double"), str(tmp_path / f"in{i}"), compression=None, files=1)
    (tmp_path / "in").mkdir()
    for i in range(2):
        for f in (tmp_path / f"in{i}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{i}.tsv")
        q = hs.write(hs.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["SNP"] for r in got) == [f"rs1_{j}" for j in range(i + 1)] and {r["A1"] for r in got} == {"A"}


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "go" in df.columns
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) >= 50


def test_the_rest_stands_without_the_training_data_package(tmp_path):
    """A copy without that package, its tests and the pipeline still imports and lists its queries."""
    import shutil

    for name in ("varloom", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gsa_st7' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) >= 50, out.stderr
