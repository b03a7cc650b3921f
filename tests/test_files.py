from __future__ import annotations

import datetime as dt

import pytest

from utterance_guard.sources import files
from utterance_guard.sources.contract import HISTORY, SchemaMismatch


def write(path, text, bom=False):
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def test_utterances(spark, tmp_path):
    path = write(tmp_path / "u.txt", "b \n\n　a　\n \nb\n")
    rows = files.read_utterances(spark, path).orderBy("row_id").collect()
    assert [r["text"] for r in rows] == ["b", "a", "b"]


def test_lexicon(spark, tmp_path):
    path = write(tmp_path / "l.txt", "# x\n\nfoo\nＦＯＯ \nKill-You\n")
    rows = files.read_lexicon(spark, path, "a").orderBy("ord").collect()
    assert [r["word"] for r in rows] == ["foo", "foo", "kill-you"]
    phrases = files.read_lexicon(spark, path, "a", files.PHRASE).orderBy("ord").collect()
    assert phrases[-1]["word"] == "kill you"
    with pytest.warns(UserWarning):
        assert files.read_lexicon(spark, str(tmp_path / "none"), "a").count() == 0


def test_labelled(spark, tmp_path):
    path = write(
        tmp_path / "d.csv", 'text,label,more\n"a,""b""\nc",1,x\nNA,0,x\n ,1.0,x\n,0,x\nq,,x\n', bom=True
    )
    rows = files.read_labelled(spark, path).orderBy("row_id").collect()
    assert [(r["text"], r["label"]) for r in rows] == [
        ('a,"b"\nc', 1), (None, 0), (" ", 1), (None, 0), ("q", None),
    ]
    with pytest.raises(SchemaMismatch):
        files.read_labelled(spark, write(tmp_path / "e.csv", "text\na\n"))


def test_eval_stops_on_bad_label(spark, tmp_path):
    good = write(tmp_path / "g.csv", "text,expected_label\na,1\nb, 0\n", bom=True)
    assert [r["expected_label"] for r in files.read_eval(spark, good).collect()] == [1, 0]
    bad = write(tmp_path / "b.csv", "text,expected_label\na,yes\n")
    with pytest.raises(Exception, match="is no number"):
        files.read_eval(spark, bad).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'x,"y"', 1), (1, "z", 0)], "row_id int, text string, label int")
    path = str(tmp_path / "out")
    files.write_csv(df, path, ["text", "label"], order_by="row_id")
    files.write_csv(df, path, ["text", "label"], order_by="row_id")
    rows = files.read_labelled(spark, path).orderBy("row_id").collect()
    assert sorted(r["text"] for r in rows) == ['x,"y"', "z"]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    run = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), None, 66, 0.12344, 0.5, 0.5, 0.5)], HISTORY
    )
    assert files.append_history(run, path) and files.append_history(run, path)
    assert not files.append_history(run, path, official=False)
    rows = files.read_history(spark, path).collect()
    assert [r["accuracy"] for r in rows] == [0.1234, 0.1234]


def test_missing_model_names_its_seed(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="seed 7"):
        files.load_models(str(tmp_path), (7,))
