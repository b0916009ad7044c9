import io
import zipfile

import pandas as pd
import pytest

from lexmill.plans import q_containers
from lexmill.sources import uploads


class Caught(Exception):
    pass


class Rows:
    """Stands for a table, and shows what is handed to its tasks."""

    schema = [type("F", (), {"dataType": type("K", (), {"simpleString": staticmethod(lambda: "string")})})]

    def select(self, *columns):
        return self

    def mapInPandas(self, f, schema):
        raise Caught(f)


def handed(make):
    with pytest.raises(Caught) as caught:
        make()
    return caught.value.args[0]


def test_segments_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(uploads, "PIECE", 500, raising=False)
    docs = pd.DataFrame([(9 * i + (i % 4 == 1), "\n".join(["x" * 30] * 5), "en") for i in range(40)], columns=["doc_id", "text", "lang"])
    files = list(handed(lambda: q_containers.packed(Rows()))(iter([docs])))
    assert len(files) > 5
    whole = pd.concat(files, ignore_index=True)
    assert len(whole) == 40 and zipfile.ZipFile(io.BytesIO(whole["content"][0])).namelist() == ["word/document.xml"]
    pieces = list(handed(lambda: uploads.docx_segments(Rows(), "name"))(iter([whole])))
    assert len(pieces) > 5 and max(p["content"].fillna("").str.len().sum() for p in pieces) < 1000
    rows = pd.concat(pieces, ignore_index=True)
    assert rows["error"].notna().sum() == 10 and len(rows) == 10 + 30 * 6
