"""Listings of folders, files written from rows, rows that stay with their media."""

import os

import pytest

from millrace.operators import reshape
from millrace.sources.listing import list_files, write_files


def test_tree_is_listed_as_the_system_walks_it(spark, tmp_path):
    for name in ["a.mp4", "b.tar.gz", "none", "x/c.MP4", "x/y/z/d.jpg", "x/é ü/\n.txt", ".hidden", "x/.part/e.mp4"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path, tmp_path / "x" / "round")
    os.symlink(tmp_path / "a.mp4", tmp_path / "x" / "link.mp4")
    got = {(r["path"], r["folder"], r["stem"], r["extension"]) for r in list_files(spark, str(tmp_path), batch=2).collect()}
    assert got == {
        ("a.mp4", "", "a", "mp4"), ("b.tar.gz", "", "b.tar", "gz"), ("none", "", "none", ""), ("x/c.MP4", "x", "c", "mp4"),
        ("x/y/z/d.jpg", "x/y/z", "d", "jpg"), ("x/é ü/\n.txt", "x/é ü", "\n", "txt"), ("x/link.mp4", "x", "link", "mp4"),
    }
    assert {r["path"] for r in list_files(spark, f"file://{tmp_path}", ".MP4").collect()} == {"a.mp4", "x/c.MP4", "x/link.mp4"}


def test_no_folder_and_an_empty_one_have_no_files(spark, tmp_path):
    assert list_files(spark, f"{tmp_path}/none").count() == 0 and list_files(spark, str(tmp_path)).count() == 0


def test_files_hold_their_rows(spark, tmp_path):
    long = "x" * 300_000
    rows = [("a/1", "é"), ("a/1", "z"), ("b/c/2", None), ("3", ""), ("4", long)]
    sizes = write_files(spark.createDataFrame(rows, "to string, text string").repartition(3), str(tmp_path), "to", "text")
    assert {tuple(r) for r in sizes.collect()} == {("a/1", 2), ("b/c/2", 0), ("3", 0), ("4", 300_000)}
    assert (tmp_path / "a/1").read_text() == "é" and (tmp_path / "4").read_text() == long
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith(".")]
    empty = spark.createDataFrame([], "to string, text string")
    assert write_files(empty, str(tmp_path), "to", "text").count() == 0


@pytest.mark.parametrize("path", [None, "", "/etc/x", "a/../../x"])
def test_paths_stay_below_the_folder(spark, tmp_path, path):
    with pytest.raises(Exception, match="no path below the folder"):
        write_files(spark.createDataFrame([(path, "x")], "to string, text string"), str(tmp_path), "to", "text")


def test_rows_stay_with_all_their_media(spark):
    rows = [(1, ["a", "b"]), (2, ["a", "c"]), (3, []), (4, None), (5, ["a", None]), (6, ["b"]), (7, ["a", "b"]), (8, ["a", "a"])]
    df = spark.createDataFrame([(i, m, "x") for i, m in rows], "id int, media array<string>, path string")
    listing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    got = reshape.media_present(df, listing, "media")
    assert got.columns == df.columns and {r["id"] for r in got.collect()} == {1, 6, 7, 8}
    assert reshape.media_present(df, listing.limit(0), "media").count() == 0
