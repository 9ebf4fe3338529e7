import io
import json
import zipfile

import pytest

from faultline.api import diagnose_path, diagnose_text, is_folder
from faultline.config import DEFAULT, load_settings
from faultline.operators.translator import SIGNALS, signals, worst_severity
from faultline.sources import files as S

LOG = "2024-03-07T02:44:18+00:00\nORA-27072: File I/O error\nLinux-x86_64 Error: 5: Input/output error\n2024-03-07T02:44:19Z db1 kernel: blk_update_request: I/O error, dev sdb, sector 9"


def test_text_and_archive(spark, tmp_path):
    rules = {"DISK_GONE": {"match_any": ["File I/O error"], "severity": "CRITICAL"}, "ORA_ANY_GENERIC": {"match_any": ["ORA-"], "severity": "ERROR"}}
    out = diagnose_text(spark, LOG, rules=rules)
    assert {r["event"] for r in out["others"].where("row_kind = 'PATTERN_MATCH'").collect()} == {"DISK_GONE"}
    assert out["report"].first()["incident"] == "input"
    assert [r["error"] for r in out["codes"].collect()] == ["ORA-27072"]
    assert {r["code"] for r in out["signals"].collect()} == {"OS_SCSI_TIMEOUT"}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("alert.log", LOG)
        z.writestr("bin", b"a\0b")
    out = diagnose_path(spark, f"file://{tmp_path}/b.zip")
    assert out["timeline"].count() >= 3 and [r["skip_reason"] for r in out["skipped"].collect()] == ["binary"]
    (tmp_path / "one.log").write_text(LOG)
    assert diagnose_path(spark, f"file://{tmp_path}/one.log")["report"].count() == 1


def test_a_folder_may_have_a_dot(spark, tmp_path):
    (tmp_path / "case.1").mkdir()
    (tmp_path / "case.1" / "log").write_text(LOG)
    found = [is_folder(spark, f"file://{tmp_path}/{name}") for name in ("case.1", "case.1/log", "none")]
    assert found == [True, False, False]


def test_registry(spark):
    assert len(SIGNALS) == 44 and len({c for c, *_ in SIGNALS}) == 44
    df = spark.createDataFrame([("a", "nf_conntrack: table full, dropping packet"), ("b", "mce: corrected"), ("c", "fine")], "path string, text string")
    found = signals(df)
    assert [(r["path"], r["code"]) for r in found.orderBy("path", "rule").collect()] == [("a", "OS_CONNTRACK_FULL"), ("a", "NF_CONNTRACK_FULL"), ("b", "MCE_CORRECTED_MEMORY")]
    assert {r["path"]: r["severity"] for r in worst_severity(found).collect()} == {"a": "CRITICAL", "b": "WARNING"}


def test_settings_file(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"retrieval": {"top_k": 3, "other": 1}, "storm_gap_sec": 7, "logical_codes": ["X"]}))
    s = load_settings(str(tmp_path / "s.json"))
    assert (s.top_k, s.storm_gap_sec, s.logical_codes, s.rrf_k) == (3, 7, ("X",), DEFAULT.rrf_k)
    (tmp_path / "s.yaml").write_text("retrieval:\n  top_k: 4\n")
    try:
        assert load_settings(str(tmp_path / "s.yaml")).top_k == 4
    except ValueError as error:
        assert "YAML" in str(error)


def test_seeds(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"chunk_id": "a"}\n{"chunk_id": "b"}\n{"chunk_id": "b"}\n')
    stored = spark.createDataFrame([("a",)], "chunk_id string")
    assert [r["chunk_id"] for r in S.load_seeds(spark, f"file://{tmp_path}/seed.json", stored).collect()] == ["b"]


@pytest.mark.parametrize("path,points", [("/x/alert_db.log", 102), ("/grid/crs/ocssd.trc", 62), ("/var/log/messages", 57 - 2), ("/x/osw/y", 42), ("/a/iostat.dat", 42)])
def test_file_points(spark, path, points):
    from pyspark.sql import functions as F

    from faultline.functions.text import file_priority

    assert spark.range(1).select(file_priority(F.lit(path))).first()[0] == points
