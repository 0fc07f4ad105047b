"""Exports, written and read back."""

import csv
import io

from docrecords.sources import export


def test_cells_come_back_as_they_were(spark, tmp_path):
    cells = ['plain', ' blank ', 'a,b', 'say "hi"', 'two\nlines', '=1+1', '-x', '', None, "é'", "@at"]
    names = list(export.EXPORT_COLUMNS.values())
    rows = [tuple(cells[(i + k) % len(cells)] for k in range(len(names))) for i in range(len(cells))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    export.export_csv(frame.coalesce(1), f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    got = list(csv.reader(io.StringIO(text)))

    def guarded(c):
        return "" if c is None else f"'{c}" if c[:1] in tuple("=+-@\t\r") and c else c

    assert got[0] == list(export.EXPORT_COLUMNS)
    assert sorted(got[1:]) == sorted([guarded(c) for c in r] for r in rows)


def test_empty_fields_are_written(spark, tmp_path):
    frame = spark.createDataFrame([(1, None), (2, 'x "y"')], "id int, name string")
    export.export_json(frame.coalesce(1), f"{tmp_path}/json")
    lines = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*")).splitlines()
    assert lines == ['{"id":1,"name":null}', '{"id":2,"name":"x \\"y\\""}']
