import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import uploads
from ledgerloom.schemas import MAX_UPLOAD_BYTES
from ledgerloom.sources import headers, readers

FILES = {
    "a.pdf": b"%PDF-1.7\n" + b"x" * 500,
    "b.png": bytes.fromhex("89504E470D0A1A0A") + b"y" * 40,
    "sub/c.jpg": b"not a picture",
    "sub/deep/d.webp": b"RIFF\x24\x00\x00\x00WEBPVP8 ",
    "empty.gif": b"",
    "short.pdf": b"%P",
    "notes.txt": b"hello",
    "_SUCCESS": b"",
    ".hidden.pdf": b"%PDF-1",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    for name, size in (("huge.pdf", 1 << 30), ("limit.pdf", MAX_UPLOAD_BYTES), ("over.pdf", MAX_UPLOAD_BYTES + 1)):
        (root / name).write_bytes(b"%PDF-1.4\n")
        os.truncate(root / name, size)
    return str(root)


def seen(rows):
    return {os.path.basename(r.path): (r.length, None if r.head is None else bytes(r.head)) for r in rows.collect()}


def test_names_sizes_and_leading_bytes(spark, folder):
    got = seen(headers.read_headers(spark, folder))
    want = {os.path.basename(n): (len(c), c[:16]) for n, c in FILES.items() if n[0] not in "_."}
    head = (b"%PDF-1.4\n" + bytes(16))[:16]
    want |= {"huge.pdf": (1 << 30, head), "limit.pdf": (MAX_UPLOAD_BYTES, head), "over.pdf": (MAX_UPLOAD_BYTES + 1, head)}
    assert got == want


def test_the_readers_of_any_store_give_the_same_but_for_large_files(spark, folder):
    own, other = seen(headers.read_headers(spark, "file:" + folder)), seen(headers.read_headers(spark, folder, by_spark=True))
    for name in ("huge.pdf", "over.pdf"):
        assert other[name] == (own[name][0], None)
    for name in ("huge.pdf", "over.pdf", "empty.gif"):
        own.pop(name), other.pop(name, None)
    assert own == other


@pytest.mark.parametrize("by_spark", [False, True])
def test_a_gigabyte_is_refused_unread(spark, folder, by_spark):
    started = time.time()
    checked = uploads.check_uploads(readers.read_files(spark, folder, by_spark=by_spark))
    reasons = {r.filename: r.reject_reason for r in checked.collect()}
    too_large = uploads.TOO_LARGE.format(noun="PDF", limit=10)
    assert reasons["huge.pdf"] == reasons["over.pdf"] == too_large
    assert [reasons[n] for n in ("a.pdf", "b.png", "d.webp", "limit.pdf")] == [None] * 4
    assert by_spark or reasons["empty.gif"] == uploads.EMPTY.format(noun="image")
    assert reasons["short.pdf"] == uploads.NOT_PDF and reasons["c.jpg"] == uploads.NOT_IMAGE
    assert reasons["notes.txt"].endswith('"undefined".')
    # No column of the rows holds more than the leading bytes.
    assert checked.agg(F.max(F.length("content")).alias("most")).first().most == headers.HEAD_BYTES
    assert time.time() - started < 60


def test_large_files_are_not_opened_by_spark(spark, folder):
    plan = headers.read_headers(spark, folder, by_spark=True)._jdf.queryExecution().executedPlan().toString()
    scans = [p for p in plan.split("FileScan")[1:]]
    assert len(scans) == 2 and sum("content" in s.split("Batched")[0] for s in scans) == 1
    assert all("length" in s.split("PushedFilters")[1][:80] for s in scans)


def test_files_are_dealt_to_tasks_and_no_file_is_fine(spark, folder, tmp_path):
    reader = headers.HeaderReader({"path": folder, "filesATask": "4"})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [4, 4, 2]
    assert headers.read_headers(spark, str(tmp_path)).count() == 0
    assert seen(headers.read_headers(spark, os.path.join(folder, "a.pdf"))) == {"a.pdf": (509, FILES["a.pdf"][:16])}


def test_only_the_leading_bytes_are_read(folder, monkeypatch):
    asked = []
    own = open

    def counting(path, *args, **kwargs):
        file = own(path, *args, **kwargs)

        class Counted:
            def __enter__(self):
                return self

            def __exit__(self, *why):
                file.close()

            def fileno(self):
                return file.fileno()

            def read(self, count):
                asked.append(count)
                return file.read(count)

        return Counted()

    monkeypatch.setattr("builtins.open", counting)
    size, _, head = headers.header_of(os.path.join(folder, "huge.pdf"), 16)
    assert size == 1 << 30 and len(head) == 16 and sum(asked) == 16
