import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture()
def folder(spark, tmp_path):
    """Write small tables, empty where not given, and return the folder; extra columns clash on purpose."""

    def write(extra="", **rows):
        for name, schema in SCHEMAS.items():
            wide = ", ".join(f"{c} string" for c in extra.split())
            full = schema + (", " + wide if wide else "")
            data = [tuple(r) + ("x",) * (len(full.split(", ")) - len(r)) for r in rows.get(name, [])]
            spark.createDataFrame(data, full).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write

