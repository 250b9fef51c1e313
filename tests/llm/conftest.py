import pytest

SCHEMA = "layer_id bigint, file_id string, page_index int, native_text string, ocr_text string, text string, stored string, form string, field_name string"


@pytest.fixture()
def pages(spark):
    """Page rows from (native, ocr) pairs, with columns of clashing names besides."""

    def make(*pairs, files=None):
        rows = [(i, (files or {}).get(i, "f"), i, n, o, "x", "x", "x", "x") for i, (n, o) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture()
def audit(spark):
    def make(*rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "audit_id bigint, input_file string, page int, summary string, quality_flags array<string>")

    return make
