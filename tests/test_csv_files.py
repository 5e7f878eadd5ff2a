"""Delimited files with headers of their own, quoted line breaks, rows of wrong length, bad bytes and no content."""

import os

from touchline.sources import tables


def test_files_of_every_kind(spark, tmp_path):
    texts = {
        "plain.csv": b"id,name\n1,a\n2,b\n",
        "quoted.csv": b'id,name\n1,"two\nlines, and ""quotes"""\n\n2,"x"\n',
        "bom.csv": b"\xef\xbb\xbfid,name\n1,\xc3\xa9\n",
        "short.csv": b"id,name,\n1\n2,b\n3,c,d\n",
        "long.csv": b'id,name\n1,a,more,still\n2,"b,c"\n3,"x, y","extra"\n',
        "broken.csv": b"id,name\n1,\xff\xfe\n2,b,more\n3,c\n",
        "double.csv": b"name,id,name\nx,1,y\n",
        "only.csv": b"id,name\n",
        "blank.csv": b"\n\n",
        "other file.csv": "id,größe\n1,\"ü\r\nü\"\n".encode(),
    }
    folder = tmp_path / "nation tier" / "team"
    os.makedirs(folder)
    for name, raw in texts.items():
        (folder / name).write_bytes(raw)
    rows, modes = tables.read_csv_files(spark, [str(tmp_path)])
    base = lambda p: os.path.basename(p)
    assert {base(r["path"]): r["read_mode"] for r in modes.collect()} == {
        **dict.fromkeys(texts, "normal"), "long.csv": "repaired_field_count", "broken.csv": "python_skip_bad_lines", "blank.csv": "empty"}
    got = {}
    for r in rows.collect():
        got.setdefault(base(r["source_path"]), []).append({k: v for k, v in r.asDict().items() if v is not None and k != "source_path"})
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        "plain.csv": [{"id": "1", "name": "a"}, {"id": "2", "name": "b"}],
        "quoted.csv": [{"id": "1", "name": 'two\nlines, and "quotes"'}, {"id": "2", "name": "x"}],
        "bom.csv": [{"id": "1", "name": "é"}],
        "short.csv": [{"id": "1", "name": "", "unnamed_2": ""}, {"id": "2", "name": "b", "unnamed_2": ""}, {"id": "3", "name": "c", "unnamed_2": "d"}],
        "long.csv": [{"id": "1", "name": "a"}, {"id": "2", "name": "b,c"}, {"id": "3", "name": "x, y"}],
        "broken.csv": [{"id": "1", "name": "��"}, {"id": "3", "name": "c"}],
        "double.csv": [{"name": "x", "id": "1", "name_1": "y"}],
        "other file.csv": [{"id": "1", "größe": "ü\r\nü"}],
    }


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b" \n\n")
    rows, modes = tables.read_csv_files(spark, [str(tmp_path)])
    assert rows.count() == 0 and [r["read_mode"] for r in modes.collect()] == ["empty"]
