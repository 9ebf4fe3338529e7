import io
import tarfile
import zipfile
from pathlib import Path

import pytest
from faultline.sources import archives as A
from faultline.sources.files import Limits


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def got(spark, folder, limits=Limits()):
    rows = A.read_bundles(spark, f"file://{folder}", limits).collect()
    short = lambda r: r["path"].split(f"{folder.name}/", 1)[1]
    return sorted((short(r), r["text"], r["skip_reason"]) for r in rows)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_every_kind_of_archive(spark, folder):
    deep = zipped([("c.log", b"deep"), ("again.zip", zipped([("d", b"deeper")]))])
    for suffix, data in ((".zip", zipped), (".tar", tarred), (".tar.gz", lambda e: tarred(e, "w:gz")), (".tgz", lambda e: tarred(e, "w:gz")), (".tar.bz2", lambda e: tarred(e, "w:bz2")), (".tar.xz", lambda e: tarred(e, "w:xz"))):
        (folder / f"b{suffix}").write_bytes(data([("a b.log", b"one \xff"), ("x/in.zip", deep), ("bin", b"a\0"), ("../evil", b"x"), ("a b.log", b"second of a name"), ("empty", b"")]))
    (folder / "plain.txt").write_bytes(b"no archive")
    (folder / "none.zip").write_bytes(zipped([]))
    want = [("plain.txt", "no archive", None)]
    for suffix in (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"):
        b = f"b{suffix}"
        want += [(f"{b}!/a b.log", "one �", None), (f"{b}!/x/in.zip!/c.log", "deep", None), (f"{b}!/x/in.zip!/again.zip!/d", "deeper", None), (f"{b}!/bin", None, "binary"), (f"{b}!/../evil", None, "path_traversal_or_empty"), (f"{b}!/empty", "", None)]
    assert got(spark, folder) == sorted(want)


def test_broken_archives(spark, folder):
    whole = zipped([("a", b"good"), ("b", b"bad bad bad"), ("c", b"good too")], zipfile.ZIP_STORED)
    (folder / "m.zip").write_bytes(whole.replace(b"bad bad bad", b"bad bAd bad"))
    (folder / "n.zip").write_bytes(b"no archive")
    (folder / "o.zip").write_bytes(zipped([("x", b"packed in another way")], zipfile.ZIP_BZIP2))
    (folder / "p.tar").write_bytes(b"no archive either")
    (folder / "q.tar.gz").write_bytes(tarred([("first", b"kept"), ("second", bytes(range(256)) * 4000)], "w:gz")[:-400])
    found = got(spark, folder)
    assert [x for x in found if x[0].startswith("m.zip")] == [("m.zip!/a", "good", None), ("m.zip!/b", None, "member_read_failed:BadZipFile"), ("m.zip!/c", "good too", None)]
    assert ("n.zip", None, "archive_open_failed:BadZipFile") in found and ("o.zip!/x", "packed in another way", None) in found and ("p.tar", None, "archive_open_failed:ReadError") in found
    assert ("q.tar.gz!/first", "kept", None) in found and [r for p, _, r in found if p == "q.tar.gz"][0].startswith("archive_open_failed")


def test_limits(spark, folder):
    inner = [(f"i{k}.zip", zipped([("f", b"x"), ("j.zip", zipped([("g", b"y")]))])) for k in range(4)]
    (folder / "b.zip").write_bytes(zipped([*inner, ("big", b"z" * 900), ("huge", b"z" * 5000)]))
    reasons = lambda limits: {p: r for p, _, r in got(spark, folder, limits) if r}
    size = dict(member_bytes=4000, text_bytes=800)
    assert reasons(Limits(**size)) == {"b.zip!/big": "text_too_large", "b.zip!/huge": "file_too_large"}
    assert reasons(Limits(depth=2)) == {f"b.zip!/i{k}.zip!/j.zip": "max_nesting_depth" for k in range(4)}
    # the bundle, four archives in it and two in these
    assert reasons(Limits(nested=7)) == {f"b.zip!/i{k}.zip!/j.zip": "max_nested_archive_expansions" for k in (2, 3)}
    assert reasons(Limits(zip_members=5)) == {"b.zip!/*": "max_zip_members_exceeded"}
    assert sorted(reasons(Limits(files=3)).values()) == ["max_files"] * 7


def test_a_bundle_is_read_by_many_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(A, "TASK_BYTES", 50_000)
    (folder / "b.zip").write_bytes(zipped([(f"f{k}", b"%06d" % k * 2000) for k in range(60)], zipfile.ZIP_STORED))
    out = A.read_bundles(spark, f"file://{folder}")
    assert out.count() == 60 and out.where("substring(text, 7, 6) = substring(text, 1, 6)").count() == 60
    reads = []
    with A._opened(f"file://{folder}/b.zip") as f:
        size = (folder / "b.zip").stat().st_size
        entries = list(A.listed("b.zip", f, size, Limits()))
        whole = f.raw.file.read
        f.raw.file = type("Counted", (), {"read": lambda self, n: (reads.append(n), whole(n))[1], "size": f.raw.file.size, "seek": f.raw.file.seek, "tell": f.raw.file.tell, "close": f.raw.file.close})()
        _, kind, start, packed, length, method, crc, _ = entries[30]
        assert A.member_bytes(f, kind, start, packed, length, method, crc, Limits()) == b"000030" * 2000
    assert sum(reads) < size / 3


def test_the_query_keeps_its_bundles_small(spark, tmp_path):
    import __spark_entry__

    events = [(k, k % 3, f'{{"k": {k}}}') for k in range(30)]
    spark.createDataFrame(events, "event_id long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("bundles*/*.zip"))
    rows = __spark_entry__.queries()["archive_members"](spark, str(tmp_path)).collect()
    assert len(rows) == 18 and sum(r.skip_reason == "text_too_large" for r in rows) == 3
    bundles = set(shared.glob("bundles*/*.zip")) - before
    assert len(bundles) == 3 and all(b.stat().st_size < 100_000 for b in bundles)
