
import pytest

from poolspark.functions.features import DESCRIPTORS
from poolspark.operators.clean import aggregate_clean, build_master, clean
from poolspark.operators.report import summarize
from poolspark.plans.prepare import prepare_labelled, prepare_targets, write_master
from poolspark.session import shared_dir
from poolspark.sources import tables
from poolspark.sources.registry import registry_from_rows
from poolspark.streaming.clean_stream import clean_stream, read_cleaned

HEADER = ["Id", "Target Name", "Ligand SMILES", "Ki (nM)", "Extra", "Kd (nM)", "IC50 (nM)"]
LINES = [
    ["1", "EGFR kinase", "CC(=O)Oc1ccccc1", "10", "x", "", ""],
    ["2", "EGFR kinase", "CC(=O)Oc1ccccc1", "<1,000", "x", "", ""],
    ["3", "EGFR kinase", "CCO", "NA", "x", ">5000", "7"],
    ["4", "NA", "CCN", "5", "x", "", ""],
    ["5", "JAK2", "", "5", "x", "", ""],
    ["6", "JAK2", "CCCCCCN", "nan", "x", "NULL", " 90 "],
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "all.tsv"
    path.write_text("\n".join("\t".join(line) for line in [HEADER, *LINES]) + "\n")
    return str(path)


def test_dump_reader(spark, dump):
    df = tables.read_measurements(spark, dump)
    assert df.columns == ["target_name", "raw_key", "ki", "kd", "ic50"]
    rows = df.collect()
    assert len(rows) == 6 and rows[3].target_name is None and rows[4].raw_key is None and rows[2].ki is None
    assert rows[5] == ("JAK2", "CCCCCCN", None, None, " 90 ")
    plan = df.select("ki")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Ki (nM):string>" in plan
    with pytest.raises(ValueError, match="the table has no columns"):
        tables.read_measurements(spark, dump, {"Absent": "a"})
    names = [(r.ordinal, r.name) for r in tables.source_columns(spark, dump).collect()]
    assert names == list(enumerate(HEADER))


def test_prepare_end_to_end(spark, dump, tmp_path):
    master, base = str(tmp_path / "master"), str(tmp_path / "targets")
    write_master(spark, dump, master)
    assert tables.read_master(spark, master).count() == 3
    reg = registry_from_rows(spark, [("EGFR", "egfr", None, 500.0), ("JAK2", "JAK2", "exact", 50.0), ("GONE", "zzz", None, None)])
    with pytest.raises(ValueError, match="no name matches 'zzz' .target GONE."):
        prepare_targets(spark, master, reg, base)
    prepare_targets(spark, master, reg, base, ["EGFR", "JAK2"])
    egfr = tables.read_target(spark, f"{base}/prepared", "EGFR").collect()
    assert len(egfr) == 1 and egfr[0].label == 0 and egfr[0].fp == sorted(set(egfr[0].fp))
    assert tables.read_target(spark, f"{base}/clean", "EGFR").count() == 2
    assert set(DESCRIPTORS) <= set(tables.read_target(spark, f"{base}/descriptors", "JAK2").columns)
    with pytest.raises(FileNotFoundError):
        tables.read_target(spark, f"{base}/prepared", "ABL1")
    docs = {r.target: r for r in tables.read_metadata(spark, f"{base}/metadata/*.json").collect()}
    assert docs["EGFR"].n_molecules_raw == 2 and docs["EGFR"].n_molecules_valid == 1 and docs["EGFR"].fingerprint.n_bits == 2048
    plan = spark.read.parquet(f"{base}/prepared").where("target = 'EGFR'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target" in plan
    assert tables.target_dir(base + "/prepared/", "EGFR") == f"{base}/prepared/target=EGFR"


def test_metadata_of_many_targets_in_one_file(spark, tmp_path):
    docs = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "target string, n_molecules_raw int").coalesce(1)
    tables.write_metadata(docs, str(tmp_path / "lines"))
    assert sorted(tuple(r) for r in tables.read_metadata(spark, str(tmp_path / "lines")).select("target", "n_molecules_raw").collect()) == [("A", 1), ("B", 2), ("C", 3)]
    assert tables.read_metadata(spark, str(tmp_path / "lines")).where("active_fraction IS NULL").count() == 3
    (tmp_path / "one").mkdir()
    for name in "AB":
        (tmp_path / "one" / f"{name}.json").write_text(f'{{\n  "target": "{name}",\n  "n": 7\n}}\n')
    whole = tables.read_metadata(spark, str(tmp_path / "one"), one_per_file=True)
    assert sorted(r.target for r in whole.collect()) == ["A", "B"]


def test_prepare_labelled(spark, tmp_path):
    rows = spark.createDataFrame([("CCCCO", 1), ("CC", 0), (None, 1), ("CCCCN", None)], "entity_key string, label int")
    rows.write.parquet(str(tmp_path / "in"))
    prepare_labelled(spark, str(tmp_path / "in"), "OLD", str(tmp_path / "out"))
    assert tables.read_target(spark, str(tmp_path / "out/clean"), "OLD").count() == 2
    assert [r.label for r in tables.read_target(spark, str(tmp_path / "out/prepared"), "OLD").collect()] == [1]


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "entity_key string, label int")
    assert tables.require_columns(df, ["entity_key", "label"]).count() == 1
    with pytest.raises(ValueError, match="no columns \\['smiles'\\]"):
        tables.require_columns(df, ["smiles"])


def test_summary_and_history_round_trip(spark, tmp_path):
    rows = [("T", "random", "greedy", r, 0.5 + r / 100, 20 + r, [1, 2] if r < 10 else None) for r in range(11)]
    history = spark.createDataFrame(rows, "target string, initialization_strategy string, strategy string, round int, roc_auc double, n_actives_found int, selected array<bigint>")
    tables.write_table(history, str(tmp_path / "history"), partition_by=())
    back = spark.read.parquet(str(tmp_path / "history"))
    assert back.where("round = 10").head().selected is None and back.where("round = 0").head().selected == [1, 2]
    tables.write_summary(summarize(history), str(tmp_path / "summary"))
    got = tables.read_summary(spark, str(tmp_path / "summary")).collect()
    assert len(got) == 1 and got[0].roc_auc_mean == pytest.approx(0.6) and got[0].roc_auc_std is None


def test_files_with_different_headers_are_refused(spark, tmp_path):
    columns = list(tables.MEASUREMENT_COLUMNS)
    (tmp_path / "a.tsv").write_text("\t".join(columns) + "\nT\tC\t1\t2\t3\n")
    assert tables.read_measurements(spark, str(tmp_path)).collect()[0].ki == "1"
    swapped = [columns[0], columns[1], columns[4], columns[3], columns[2]]
    (tmp_path / "b.tsv").write_text("\t".join(swapped) + "\nT\tC\t3\t2\t1\n")
    with pytest.raises(Exception, match="CSV header"):
        tables.read_measurements(spark, str(tmp_path)).collect()


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    schema = "target_name string, raw_key string, ki string, kd string, ic50 string"
    first = spark.createDataFrame([("T", f"m{i % 5}", str(i + 1), None, None) for i in range(40)], schema)
    later = spark.createDataFrame([("T", "m9", "abc", "4", None), ("T", None, "4", None, None)], schema)
    source, sink, marks = (str(tmp_path / p) for p in ("in", "out", "marks"))
    first.repartition(3).write.parquet(source)
    for part in (None, later, None):
        if part is not None:
            part.write.mode("append").parquet(source)
        clean_stream(spark, source, first.schema, sink, marks)
    both = first.unionByName(later)
    assert sorted(map(str, read_cleaned(spark, sink).collect())) == sorted(map(str, clean(both).collect()))
    key = lambda df: sorted((r.entity_key, r.value_median, r.n_meas) for r in df.collect())
    assert key(aggregate_clean(read_cleaned(spark, sink))) == key(build_master(both))


def test_shared_dir_prefers_the_session_setting(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
