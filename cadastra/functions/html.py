"""HTML extraction: labels and values, headings, tables, colour-coded grids, links.

A small state machine over ``html.parser``; it runs in ``mapInArrow`` over whole pages, one page at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import ship_package

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "legend"}
SILENT = {"script", "style", "noscript"}
BLANK = {"", "-", "--", "n/a", "na", "nil", "none"}
#: Bounds outside of which coordinates are not believed.
LATITUDES, LONGITUDES = (6.0, 36.0), (68.0, 98.0)
NUMBER = r"(-?\d+(?:\.\d+)?)"


def squash(text: str) -> str:
    return " ".join(text.split())


class PageParser(HTMLParser):
    """Collects ``fields`` (section, label, value), ``tables``, ``grid``, ``links`` and the title of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.section = "", "General"
        self.fields: list[tuple[str, str, str]] = []
        self.tables: list[dict] = []
        self.grid: list[dict[str, str]] = []
        self.links: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._capture: str | None = None
        self._table: list[list[str]] | None = None
        self._row: list[str] | None = None
        self._cell: list[str] | None = None
        self._label: str | None = None
        self._link: tuple[str, list[str]] | None = None
        self._grid_on = False
        self._unit: str | None = None
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag in SILENT:
            self._silent += 1
        if tag in HEADINGS or tag in ("title", "label"):
            self._capture, self._text = tag, []
        elif tag == "table":
            self._table = []
        elif tag == "tr" and self._table is not None:
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []
        elif tag == "a":
            self._link = (values.get("href", ""), [])
        elif tag in ("input", "textarea") and values.get("type", "text") not in ("hidden", "submit", "button"):
            self._value(values.get("value", ""))
        elif tag == "option" and "selected" in values:
            self._capture, self._text = "option", []
        if self._grid_on and tag in ("div", "td", "span") and values.get("class", "").startswith("bg_ll"):
            self.grid.append({"class": values["class"].split()[0], "text": "", "title": squash(values.get("title", ""))})
            self._unit = tag

    def _value(self, text: str) -> None:
        text = squash(text)
        if text.lower() in BLANK:
            return
        if self._cell is not None:
            self._cell.append(text)
        elif self._label:
            self.fields.append((self.section, self._label, text))
            self._label = None

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._unit:
            self.grid[-1]["text"] = squash(f"{self.grid[-1]['text']} {data}")
        if self._link is not None:
            self._link[1].append(data)
        if self._capture:
            self._text.append(data)
        elif self._cell is not None:
            self._cell.append(data)
        elif self._label and squash(data):
            self._value(data.lstrip(" :\n\t"))
        elif self._table is None and (found := re.match(r"^\s*([A-Za-z][A-Za-z .()/]{1,60}?)\s*:\s*(\S.*)$", data)):
            self.fields.append((self.section, squash(found[1]), squash(found[2])))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self._silent:
            self._silent -= 1
        if tag == self._unit:
            self._unit = None
        if tag == self._capture:
            text, self._capture = squash("".join(self._text)), None
            if tag == "title":
                self.title = text
            elif tag in HEADINGS and text:
                self.section, self._label = text, None
                self._grid_on = "inventory status" in text.lower()
            elif tag == "label" and text:
                if self._cell is not None:
                    self._cell.append(text)
                else:
                    self._label = text.rstrip(" :*")
            elif tag == "option":
                self._value(text)
        elif tag in ("td", "th") and self._cell is not None and self._row is not None:
            self._row.append(squash(" ".join(self._cell)))
            self._cell = None
        elif tag == "tr" and self._row is not None and self._table is not None:
            if any(self._row):
                self._table.append(self._row)
            self._row = None
        elif tag == "table" and self._table is not None:
            self._close_table()
        elif tag == "a" and self._link is not None:
            self.links.append((self._link[0], squash("".join(self._link[1]))))
            self._link = None

    def _close_table(self) -> None:
        rows, self._table = self._table or [], None
        if rows and all(len(r) in (2, 4) for r in rows):  # label and value cells side by side
            for row in rows:
                for label, value in zip(row[::2], row[1::2], strict=True):
                    if label and value.lower() not in BLANK:
                        self.fields.append((self.section, label.rstrip(" :*"), value))
        if len(rows) >= 2:
            self.tables.append({"section": self.section, "headers": rows[0], "rows": rows[1:]})


def parse_page(html: str) -> PageParser:
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    return parser


def listing_rows(parser: PageParser, wanted: dict[str, tuple[str, ...]]) -> list[dict[str, str]]:
    """Rows of the table whose headers match most of ``wanted`` (name to header words); rows without any match are dropped."""
    best: tuple[int, dict, dict[str, int]] = (0, {}, {})
    for table in parser.tables:
        heads = [h.lower() for h in table["headers"]]
        places = {name: next((i for i, h in enumerate(heads) if any(w in h for w in words)), -1) for name, words in wanted.items()}
        places = {n: i for n, i in places.items() if i >= 0}
        if len(places) > best[0]:
            best = len(places), table, places
    return [{n: row[i] for n, i in best[2].items() if i < len(row)} for row in best[1].get("rows", [])]


def map_coordinates(html: str) -> tuple[float, float] | None:
    """Latitude and longitude of an embedded map, in either order of its parts; none outside the bounds."""
    found = re.search(rf"!2d{NUMBER}!3d{NUMBER}", html or "")
    pair = (float(found[2]), float(found[1])) if found else None
    if pair is None and (found := re.search(rf"[?&](?:q|ll|center)={NUMBER},{NUMBER}", html or "")):
        pair = float(found[1]), float(found[2])
    if pair and LATITUDES[0] <= pair[0] <= LATITUDES[1] and LONGITUDES[0] <= pair[1] <= LONGITUDES[1]:
        return pair
    return None


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, n_fields, n_tables, n_links, n_grid, raw (JSON of sections, tables, grid, links) of every page."""
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, title string, n_fields int, n_tables int, n_links int, n_grid int, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_page(h) for h in batch.column("html").to_pylist()]
            raw = [json.dumps({"fields": p.fields, "tables": p.tables, "grid": p.grid, "links": p.links}, ensure_ascii=False) for p in parsed]
            counts = [pa.array([len(getattr(p, n)) for p in parsed], pa.int32()) for n in ("fields", "tables", "links", "grid")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.title for p in parsed], pa.string()), *counts, pa.array(raw, pa.string())], names=[key, "title", "n_fields", "n_tables", "n_links", "n_grid", "raw"])

    return pages.select(F.col(key), F.col(html).alias("html")).mapInArrow(run, schema)
