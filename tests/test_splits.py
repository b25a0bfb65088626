"""Files cut at every offset against readers of whole files."""

import csv
import io
import json
import random

import pytest

from timbre.schema import GENERATION_METRICS, ddl_fields
from timbre.sources import splits
from timbre.sources.json_records import json_file_records
from timbre.sources.listing import list_files, opened, with_bytes
from timbre.sources.manifests import read_manifest_json
from timbre.sources.results import read_sample_metrics

ITEMS = [
    {"a": 'x"y\\', "b": [1, {"c": "]}"}]}, 3, "{", {"a": "\\\\"}, [{"no": 1}], {}, None, {"ä": "größe\n", "d": {"e": [[]]}}, {"a": '\\"'}, [], {"z": "[,{"},
]


def json_states(path, size, split):
    rows = [{"path": path, "bytes": size, "part": n, "start": s, "stop": min(size, s + split)} for n, s in enumerate(range(0, max(size, 1), split))]
    return splits._json_states([{**r, **json.loads(json.dumps(splits._json_summary(r)))} for r in rows])


@pytest.mark.parametrize("ascii", [True, False])
@pytest.mark.parametrize("block", [3, 1 << 20])
def test_json_cut_anywhere(tmp_path, monkeypatch, ascii, block):
    monkeypatch.setattr(splits, "_BLOCK_BYTES", block)
    path = tmp_path / "x.json"
    for text in (json.dumps(ITEMS, ensure_ascii=ascii), json.dumps(ITEMS, indent=2, ensure_ascii=ascii) + "\n", "[]", " [ ] ", '[1, "{"]', '{"a": {"b": 1}}', '"[{}]"'):
        path.write_text(text, encoding="utf-8")
        whole = json.loads(text)
        want = [i for i in whole if isinstance(i, dict)] if isinstance(whole, list) else []
        size = path.stat().st_size
        for split in range(1, size + 2):
            rows = json_states(str(path), size, split)
            got = [list(splits._json_items(r)) for r in rows]
            assert [i for part in got for i in part] == want, (text, split)
            assert not isinstance(whole, list) or [r["first"] for r in rows] == [sum(map(len, got[:n])) for n in range(len(got))]


@pytest.mark.parametrize("text", ["[{}", "[{} {}]", "[{},]", "[{]", '[{"a": 1}, x]', "[{}]]", "", '{"a": {}', "[{}] 1", '[{"a: 1}]'])
def test_broken_json_ends_the_job(tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        json.loads(text)
    for split in (2, 100):
        with pytest.raises(ValueError):
            for row in json_states(str(path), len(text), split):
                list(splits._json_items(row))


def test_json_files_in_tasks(spark, tmp_path):
    draw = random.Random(4)
    (tmp_path / "many.json").write_text(json.dumps([{"ori_pth": f"{n}.wav", "ori_text": draw.choice(['"', "[{", "\\", "ü"]) * n} if n % 3 else n for n in range(200)]))
    (tmp_path / "_few.json").write_text(json.dumps([{"ori_pth": "a.wav"}]))
    files = list_files(spark, str(tmp_path))
    found = json_file_records(files, split_bytes=500)
    assert found.rdd.getNumPartitions() > 20
    rows = {(r["source_manifest"], r["source_row"]): r["ori_pth"] for r in found.collect()}
    want = {("many.json", k): f"{n}.wav" for k, n in enumerate(n for n in range(200) if n % 3)}
    assert rows == {**want, ("_few.json", 0): "a.wav"}
    whole = read_manifest_json(spark, str(tmp_path / "many.json"), "set").orderBy("source_row").collect()
    assert whole == read_manifest_json(spark, str(tmp_path / "many.json"), "set", split_bytes=700).orderBy("source_row").collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_manifest_json(spark, str(tmp_path / "gone.json"), "set").collect()
    (tmp_path / "bad.json").write_text('[{"a": 1}')
    with pytest.raises(Exception, match="no JSON array"):
        read_manifest_json(spark, str(tmp_path / "bad.json"), "set").collect()


def csv_states(path, size, split):
    rows = [{"path": path, "bytes": size, "part": n, "start": s, "stop": min(size, s + split)} for n, s in enumerate(range(0, max(size, 1), split))]
    return splits._csv_states([{**r, **splits._csv_summary(r)} for r in rows])


REGULAR = ['a,b\nx,"1\n2"\n"""q""",\n\n"",""\nlast,"x,\ny"', 'a,b\r\n"x\r\n",1\r\n2,"""\r\n"""\r\n', "a\n", "", 'h\n"\n\n"\n', "a,b\n1,2\n"]
ODD = ['a,b\nx"y,1\n2,"\n"\n', 'a\n"x"y\nz\n', 'a,b\n1,2"\n3,4\n']


@pytest.mark.parametrize("block", [2, 1 << 20])
@pytest.mark.parametrize("text", [*REGULAR, *ODD])
def test_csv_cut_anywhere(tmp_path, monkeypatch, text, block):
    monkeypatch.setattr(splits, "_BLOCK_BYTES", block)
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    for split in range(1, len(text) + 2):
        rows = csv_states(str(path), len(text), split)
        assert all(r["regular"] for r in rows) == (text in REGULAR)
        got = [r.decode() for row in rows for r in splits._csv_records(row) if r]
        assert [next(csv.reader(io.StringIO(g, newline=""))) for g in got] == want, split


def test_metric_files_in_tasks(spark, tmp_path):
    fields = [n for n, _ in ddl_fields(GENERATION_METRICS)]
    texts = ["a\nb", 'say "x"', "", ",", "c\r\nd", "plain", "é"]
    folder = tmp_path / "run" / "20240101-120000"
    folder.mkdir(parents=True)
    for name in ("a.csv", "b.csv"):
        with open(folder / name, "w", encoding="utf-8", newline="") as file:
            writer = csv.DictWriter(file, fields)
            writer.writeheader()
            writer.writerows({fields[0]: f"{name}{n}", fields[3]: texts[n % 7], "mcd": n / 4, "wer": "nan" if n % 5 == 0 else "", "sva": n % 2 == 0} for n in range(60))
    want = {f"{name}{n}": texts[n % 7] or None for name in ("a.csv", "b.csv") for n in range(60)}
    for split in (100, 1 << 20):
        found = read_sample_metrics(spark, str(folder), split_bytes=split)
        rows = found.collect()
        assert {r[fields[0]]: r[fields[3]] for r in rows} == want and len(rows) == 120
        assert {(r.run_name, r.run_ts) for r in rows} == {("run", "20240101-120000")}
        assert sum(r.mcd for r in rows) == 2 * sum(n / 4 for n in range(60))
    assert read_sample_metrics(spark, str(folder), split_bytes=100).rdd.getNumPartitions() > 20


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_text("x")
    (tmp_path / "a" / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "y.wav").symlink_to(tmp_path / "a" / "x.wav")
    listed = sorted(r["path"].removeprefix(str(tmp_path)) for r in list_files(spark, str(tmp_path)).collect())
    assert listed == ["/a/x.wav", "/y.wav"]


def test_names_of_stores(monkeypatch):
    from pyarrow import fs

    asked = []

    class Store:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return "store", uri.split("://")[1]

    monkeypatch.setattr(fs, "FileSystem", Store)
    assert opened("s3a://bucket/x/_y.wav") == ("store", "bucket/x/_y.wav", "s3a://")
    assert opened("gs://bucket/z")[1:] == ("bucket/z", "gs://") and asked == ["s3://bucket/x/_y.wav", "gs://bucket/z"]


def test_missing_files_end_the_job(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")
    with pytest.raises(Exception, match="FileNotFoundError"):
        with_bytes(files).collect()
