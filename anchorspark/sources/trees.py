"""Folders of HTML pages and of case files, with what can't be read set aside.

Spark lists the files of a tree and deals them out, so any store that Spark
reads will do.  Every file with bytes is either read whole or has a row in the
quarantine with its reason; one bad file costs no other.

Defined results: bytes of a page that aren't UTF-8 become replacement marks, of a
case file they are its reason; Spark lists no file without bytes, so an empty one
has no row; a file over ``most_bytes`` is set aside unread; a case file is taken
whole or not at all; files of the same name in different folders are different
pages; a tree without matching files gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MOST = 64 << 20
# What a case may say, and what holds where it says nothing.
PROFILES, BEHAVIOURS = ("LEGAL", "ENGINEERING"), ("answer", "abstain")
LEAST_CITATIONS, MOST_CITATIONS = 2, 8
_ANCHORS = ("must_include_any_of", "must_include_any_of_2", "must_include_all_of", "must_not_include_any_of")
CASE = (
    "id string, profile string, prompt string, test_types array<string>, origin string, corpus_scope string, target_corpora array<string>, synthesis_mode string, "
    + ", ".join(f"{k} array<string>" for k in _ANCHORS)
    + ", contract_check boolean, min_citations int, max_citations int, behavior string, min_corpora_cited int, required_corpora array<string>"
)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _too_large(files: DataFrame, most_bytes: int) -> DataFrame:
    return files.where(F.col("length") > most_bytes).select(F.col("path").alias("file"), F.lit("larger than the bound").alias("reason"))


def read_pages(spark: SparkSession, path: str, pattern: str = "*.{html,htm,xhtml}", most_bytes: int = _MOST) -> tuple[DataFrame, DataFrame]:
    """((page_id, html, modified), (file, reason)): pages of a tree, by their path, and the files set aside."""
    files = _files(spark, path, pattern)
    pages = files.where(F.col("length") <= most_bytes).select(F.col("path").alias("page_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"), F.col("modificationTime").alias("modified"))
    return pages, _too_large(files, most_bytes)


def _loaded(text: str):
    try:
        import yaml
    except ImportError:  # without the library, JSON alone
        return json.loads(text)
    return yaml.safe_load(text)


def _words(value) -> list[str]:
    return [str(x).strip() for x in value or []]


def _anchor(value) -> str:
    return "".join(str(value).lower().split())


def case_of(item: object) -> dict:
    """A case as it is stored, with its defaults; what it lacks or says wrong is a ValueError."""
    if not isinstance(item, dict):
        raise ValueError("a case must be an object")
    text = lambda k, default="": str(item.get(k) or default).strip()
    expected = item.get("expected") or {}
    profile, behavior = text("profile").upper(), str(expected.get("behavior") or "answer").strip().lower()
    mode = text("synthesis_mode").lower()
    for wrong, why in ((not text("id"), "missing id"), (profile not in PROFILES, f"profile {profile!r}"), (not text("prompt"), "missing prompt"), (behavior not in BEHAVIOURS, f"behavior {behavior!r}")):
        if wrong:
            raise ValueError(why)
    contract = bool(expected.get("contract_check", profile == "ENGINEERING"))
    least, most = expected.get("min_citations"), expected.get("max_citations")
    return {
        "id": text("id"), "profile": profile, "prompt": text("prompt"), "test_types": [x.lower() for x in _words(item.get("test_types") or ["retrieval"])], "origin": text("origin", "auto").lower(), "corpus_scope": text("corpus_scope", "single").lower(),
        "target_corpora": _words(item.get("target_corpora")), "synthesis_mode": mode if mode not in ("", "null") else None, **{k: [_anchor(x) for x in expected.get(k) or []] for k in _ANCHORS},
        "contract_check": contract, "min_citations": LEAST_CITATIONS if contract and least is None else least, "max_citations": MOST_CITATIONS if contract and most is None else most, "behavior": behavior,
        "min_corpora_cited": expected.get("min_corpora_cited"), "required_corpora": _words(expected.get("required_corpora")),
    }


def _cases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found = _loaded((content or b"").decode("utf-8"))
                found = found.get("cases") if isinstance(found, dict) else found
                if not isinstance(found, list):
                    raise ValueError("no list of cases")
                at = -1
                try:
                    stored = []
                    for at, item in enumerate(found):
                        stored.append(json.dumps(case_of(item), ensure_ascii=False))
                except (ValueError, TypeError, AttributeError) as e:
                    raise ValueError(f"case {at}: {e}") from e
                rows += [(file, case, None) for case in stored]
            except Exception as e:  # noqa: BLE001  whatever a library says of a broken file is its reason
                rows.append((file, None, (str(e).split("\n")[0] or type(e).__name__)[:300]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["file", "case", "reason"])


def read_cases(spark: SparkSession, path: str, pattern: str = "*.{yaml,yml,json}", most_bytes: int = _MOST) -> tuple[DataFrame, DataFrame]:
    """((file, fields of CASE), (file, reason)): cases of a tree of YAML and JSON files, and the files set aside."""
    files = _files(spark, path, pattern)
    rows = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(_cases, "file string, case string, reason string")
    cases = rows.where("case is not null").select("file", F.from_json("case", CASE).alias("c")).select("file", "c.*")
    return cases, rows.where("reason is not null").select("file", "reason").union(_too_large(files, most_bytes))
