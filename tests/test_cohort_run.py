import pytest
from pyspark.sql import functions as F

import binfold.plans.registry  # noqa: F401
from binfold.plans import data, q_cohort_run
from binfold.plans.cohort_run import StageStore, cohort_status, ledger, sample_files
from binfold.sources import storage, tables

DIR = "/root/testdata/sf0.001"
LINE = "r\t0\tchr1\t100\t60\t50M\t=\t200\t0\tACGT\t*\tNM:i:2"


def sam(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return f"file://{tmp_path}/{name}"


def test_scan_keeps_going_and_read_raises(spark, tmp_path):
    bad = {
        "fewer than 11 columns": LINE.rsplit("\t", 3)[0], "flag is no number of 16 bits": LINE.replace("\t0\tchr1", "\t70000\tchr1"), "no reference name": LINE.replace("chr1", ""), "position is no number": LINE.replace("\t100\t", "\tx\t"),
        "mapping quality is no number of 8 bits": LINE.replace("\t60\t", "\t256\t"), "CIGAR is malformed": LINE.replace("50M", "M50"), "mate position is no number": LINE.replace("\t200\t", "\t-3\t"), "no sequence": LINE.replace("ACGT", ""),
    }
    path = sam(tmp_path, "a.sam", ["@SQ\tSN:chr1\tLN:1000", LINE, *bad.values(), LINE])
    rows = tables.scan_sam(spark, path).orderBy("read_no").collect()
    assert [r["problem"] for r in rows] == [None, *bad, None]
    assert rows[0]["pos"] == 99 and rows[0]["mate_chrom"] == "1" and rows[0]["nm"] == 2 and rows[0]["sample_id"] == "a"
    with pytest.raises(Exception, match="malformed alignment line of sample a"):
        tables.read_sam(spark, path).collect()
    assert tables.read_sam(spark, sam(tmp_path, "b.sam", [LINE])).count() == 1


def test_list_header_is_the_first_item_only(spark, tmp_path):
    path = sam(tmp_path, "list", ["# made by hand", "", "BAM", "one.bam", " bam ", "# x", "two.bam"])
    assert sorted(r["item"] for r in tables.read_list(spark, path).collect()) == ["bam", "one.bam", "two.bam"]
    assert [r["item"] for r in tables.read_list(spark, sam(tmp_path, "other", ["one", "bam"])).collect()] == ["one", "bam"]


@pytest.fixture(scope="module")
def damaged(spark):
    out = q_cohort_run._folder(spark, "cohort")
    return q_cohort_run.write_cohort(spark, DIR, q_cohort_run._folder(spark, "sam"), True), out


def test_a_second_run_does_nothing(spark, damaged):
    sam, out = damaged
    store = q_cohort_run._run(spark, sam, out)
    assert {r["sample_id"] for r in ledger(store).collect()} == {"3", "7", "9"}
    before = {s: store.batches(s) for s in ("alignment", "counts", "gc", "qc")}
    assert [len(b) for b in before.values()] == [1, 1, 1, 1]
    again = q_cohort_run._run(spark, sam, out)
    assert {s: again.batches(s) for s in before} == before


def test_new_samples_alone_are_read(spark, damaged):
    sam, out = damaged
    q_cohort_run._run(spark, sam, out)
    q_cohort_run.sam_lines(data.reads(spark, DIR).where("sample_id = 1")).select(F.lit(77).alias("sample_id"), "value").unionByName(spark.createDataFrame([(77, "@SQ\tSN:chr1\tLN:1000000")], "sample_id int, value string")).coalesce(1).write.mode("append").partitionBy("sample_id").text(sam)
    store = q_cohort_run._run(spark, sam, out)
    newest = store.spark.read.parquet(*[f"{out}/{b}/verdicts" for b in store.batches("alignment")])
    assert len(store.batches("alignment")) == 2 and newest.where("sample_id = '77'").count() == 1 and newest.count() == 11
    assert store.read("qc").count() == 8
    status = {r["sample_id"]: r["sample_processing_status"] for r in cohort_status(store, sample_files(spark, sam)).collect()}
    assert len(status) == 11 and sorted(k for k, v in status.items() if v == "failed") == ["3", "7", "9"] and status["77"] == "success"


def test_what_has_no_commit_file_never_happened(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, x int")
    verdicts = spark.createDataFrame([("a", None, None, 0), ("b", "read", "bad", 3)], "sample_id string, step string, message string, n long")
    store.commit("alignment", lambda: rows, verdicts)
    assert [tuple(r) for r in store.read("alignment").collect()] == [("a", 1)]

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit("alignment", fails, verdicts)
    assert len(store.batches("alignment")) == 1 and store.read("counts") is None and store.passed("counts").count() == 0
    with pytest.raises(FileExistsError):
        storage.publish_text(spark, f"file://{tmp_path}/s/x", "1") or storage.publish_text(spark, f"file://{tmp_path}/s/x", "2")
    assert storage.read_text(spark, f"file://{tmp_path}/s/x") == "1"
