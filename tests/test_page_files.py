"""Page files: what is parsed, what is opened, and that filters change no row."""

import os

import pytest

from textloom.sources import page_files


class Counted(page_files.FormFeeds):
    """Notes each page that is parsed and each file that is opened."""

    def __init__(self, raw):
        super().__init__(raw)
        if raw.startswith(b"broken"):
            raise ValueError("not a document")
        self._log(f"open {raw[:2].decode()}")

    def __getitem__(self, k):
        self._log(f"page {k + 1}")
        text = super().__getitem__(k)
        if text == "bad":
            raise KeyError("bad page")
        return text

    @staticmethod
    def _log(what):
        with open(os.environ["PAGES_LOG"], "a") as f:
            f.write(what + "\n")


@pytest.fixture
def folder(tmp_path):
    for name in "ab":
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / f"{name}.txt").write_bytes("\f".join(f"{name}{k}" for k in range(1, 31)).encode())
    (tmp_path / "in" / "c.txt").write_bytes(b"c1\fbad\f\xff")
    (tmp_path / "in" / "d.txt").write_bytes(b"broken")
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    return tmp_path


def counted(spark, folder, **kw):
    """The source with a parser that logs to a file; the class is made here so that workers get it by value."""
    log = str(folder / "log")

    def open_pages(raw):
        os.environ["PAGES_LOG"] = log
        return Counted(raw)

    def done():
        text = open(log).read().split("\n")[:-1] if os.path.exists(log) else []
        if text:
            os.remove(log)
        return text

    return page_files.read(spark, str(folder / "in"), open_pages, **kw), done


@pytest.mark.parametrize("split", [10**6, 20])
def test_filters_are_pushed_to_files_and_pages(spark, folder, split):
    pages, done = counted(spark, folder, split_bytes=split)
    every = {(r.doc_id, r.page_no): (r.text, r.error) for r in pages.collect()}
    assert len(every) == 64 and every["a", 7] == ("a7", None) and every["c", 3] == ("\ufffd", None)
    assert every["c", 2] == (None, "KeyError: 'bad page'") and every["d", None] == (None, "ValueError: not a document")
    done()
    for where, want in (
        ("page_no >= 5 and page_no < 8 and doc_id = 'a'", {("a", k) for k in (5, 6, 7)}), ("page_no in (2, 29, 99) and doc_id in ('a', 'b')", {(x, k) for x in "ab" for k in (2, 29)}),
        ("page_no > 29 and page_no <= 40", {(x, 30) for x in "ab"}), ("page_no = 1 and length(text) = 2", {(x, 1) for x in "abc"}), ("doc_id = 'z'", set()), ("page_no > 3 and page_no = 2", set()),
    ):
        got = pages.where(where).where("page_no is not null").collect()
        assert {(r.doc_id, r.page_no) for r in got} == want, where
        said = done()
        assert sorted(x for x in said if x.startswith("page")) == sorted(f"page {k}" for _, k in want), where
        if "doc_id = 'a'" in where:
            assert set(x for x in said if x.startswith("open")) == {"open a1"}


def test_empty_folder_and_round_trip(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert page_files.read(spark, f"file://{tmp_path}/none").count() == 0
    rows = [("x", 2, "two\nlines"), ("x", 1, "one"), ("y", 1, None), ("z", 1, "a\fb\r")]
    page_files.write(spark.createDataFrame(rows, "doc_id string, page_no int, text string"), f"{tmp_path}/out")
    got = {(r.doc_id, r.page_no): r.text for r in page_files.read(spark, f"{tmp_path}/out").collect()}
    assert got == {("x", 1): "one", ("x", 2): "two\nlines", ("y", 1): "", ("z", 1): "a b\n"}
