"""Spreadsheet statements."""

from __future__ import annotations

import zipfile
from datetime import date
from decimal import Decimal

from tallywood.sources import xlsx


def test_movements_below_the_header(spark, tmp_path):
    rows = [["Lista"], ["Data", "Operazione", "Dettagli", "Valuta", "Importo"], ["45000", "Pos", "bar", "EUR", "-12.5"], ["17/03/2023", "Stipendio", "", "EUR", "1.234,56"], ["45001", "Pos", "x", "USD", "3"], ["45001", "Pos", "x", "EUR", "0"], ["Totale"]]
    cell = lambda r, c, v: f'<c r="{"ABCDE"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    got = [tuple(r)[1:] for r in xlsx.movements(xlsx.read_cells(spark, f"file://{tmp_path}/a.xlsx")).orderBy("line_no").collect()]
    assert got == [(3, date(2023, 3, 15), Decimal("-12.50"), "EUR", "Pos bar"), (4, date(2023, 3, 17), Decimal("1234.56"), "EUR", "Stipendio")]
