from __future__ import annotations

import json
import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from cribra.session import checkpoint_dir
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def study(nct: str | None, date: str | None = "2026-08-14", status: str = "RECRUITING",
          study_type: str = "INTERVENTIONAL", ancestors=("Neoplasms",),
          eligibility: str | None = "INCLUSION: walks unaided.") -> dict:
    """Trial-shaped study document (fixture A1 and variants)."""
    ps: dict = {"statusModule": {"overallStatus": status}}
    if nct is not None:
        ps["identificationModule"] = {"nctId": nct}
    if date is not None:
        ps["statusModule"]["lastUpdatePostDateStruct"] = {"date": date, "type": "ACTUAL"}
    if eligibility is not None:
        ps["eligibilityModule"] = {"eligibilityCriteria": eligibility}
    ps["designModule"] = {"studyType": study_type}
    doc = {"protocolSection": ps}
    if ancestors is not None:
        doc["derivedSection"] = {"conditionBrowseModule": {
            "ancestors": [{"id": f"D{i}", "term": t} for i, t in enumerate(ancestors)]}}
    return doc


def write_pages(root: str, pages: list) -> str:
    os.makedirs(root, exist_ok=True)
    for i, page in enumerate(pages):
        with open(os.path.join(root, f"page-{i:04d}.json"), "w") as f:
            f.write(page if isinstance(page, str) else json.dumps(page))
    return root


@pytest.fixture()
def pages_dir(tmp_path):
    def make(pages: list) -> str:
        return write_pages(tempfile.mkdtemp(dir=tmp_path), pages)
    return make


def line_extractor(batch):
    """A caller's extractor for tests: one criterion per non-blank line."""
    import pandas as pd
    rows = []
    for nct, text in zip(batch["nct_id"], batch["text"]):
        kept = [ln.strip() for ln in str(text).split("\n") if ln.strip()]
        rows.append({"nct_id": nct, "error": None, "criteria": [
            {"criterion_id": f"c-{i}", "text": ln, "kind": "other", "is_exclusion": False}
            for i, ln in enumerate(kept)]})
    return pd.DataFrame(rows)


# Test extractors travel to the Python workers by value.
from pyspark.cloudpickle import register_pickle_by_value  # noqa: E402

register_pickle_by_value(sys.modules[__name__])
