"""Row numbers of records in files that are read in several splits."""

import hashlib

import pytest

from quillspan.sources import files

SMALL = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "64"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, n, salt):
    lines = ["id,source,title,content"]
    for k in range(1, n + 1):
        own = "" if k % 7 == 0 else f"same{k % 3}" if k % 5 == 0 else f"{salt}{k}"
        lines.append(f"{own},{'blog' if k % 11 == 0 else 'web'},t{k},{'' if k % 13 == 0 else 'x' * (k * 37 % 90)}y{k}" if k % 13 else f"{own},web,t{k},")
    path.write_text("\n".join(lines) + "\n")
    return hashlib.sha256(path.read_bytes()).hexdigest()


@pytest.mark.parametrize("few", [65_536, 0])
def test_records_are_numbered_across_splits(spark, tmp_path, small_splits, monkeypatch, few):
    monkeypatch.setattr(files, "FEW_SPLITS", few)
    sha = {f"{name}.csv": write(tmp_path / f"{name}.csv", n, name) for name, n in (("a", 1500), ("b", 3), ("c", 700))}
    raw = files.documents_csv_scan(spark, str(tmp_path), multi_line=False)
    assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 5
    short = lambda path: path.rpartition("/")[2]
    assert all(r.title == f"t{r.row}" for r in raw.select("row", "title").collect())
    valid, rejects = files.row_quarantine(raw)
    assert {(short(r.file), r.row): r.reason for r in rejects.collect()} == {(f"{f}.csv", k): "empty content" if k % 13 == 0 else "invalid source" for f, n in (("a", 1500), ("b", 3), ("c", 700)) for k in range(1, n + 1) if k % 13 == 0 or k % 11 == 0}
    kept, again = files.ingest_row_dedupe(valid)
    want, seen = {}, set()
    for f, n in (("a", 1500), ("b", 3), ("c", 700)):
        for k in range(1, n + 1):
            if k % 13 and k % 11:
                own = "" if k % 7 == 0 else f"same{k % 3}" if k % 5 == 0 else f"{f}{k}"
                want[f + ".csv", k] = bool(own) and (f, own) in seen
                seen.add((f, own))
    assert {(short(r.file), r.row) for r in kept.collect()} == {x for x, twice in want.items() if not twice}
    twice = {(short(r.file), r.row) for r in again.collect()}
    assert twice == {x for x, own in want.items() if own} and len(twice) > 300
    receipts = {short(r.file): r for r in files.ingest_receipt(kept, rejects.unionByName(again), examples=3, hashes=files.file_hashes(spark, str(tmp_path))).collect()}
    assert {f: r.sha256 for f, r in receipts.items()} == sha
    assert {f: r.rows_read for f, r in receipts.items()} == {"a.csv": 1500, "b.csv": 3, "c.csv": 700}
    a = receipts["a.csv"]
    assert a.created + a.skipped == 1500 and a.examples == "11:invalid source,13:empty content,20:duplicate id"


def test_receipt_of_a_file_without_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,source,title,content\n")
    valid, rejects = files.row_quarantine(files.documents_csv_scan(spark, str(tmp_path)))
    r = files.ingest_receipt(valid, rejects, hashes=files.file_hashes(spark, str(tmp_path))).first()
    assert (r.rows_read, r.created, r.skipped, r.examples) == (0, 0, 0, "")
