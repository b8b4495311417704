"""The unit of bare weights is told from all rows."""

from lotwise.sources import grid


def test_rows_after_many_blanks_count(spark):
    """The first 500 rows have no weight; the later ones agree."""
    rows = [("d", i, None if i < 600 else "2", "2 kg") for i in range(620)] + [("few", i, "2", "2 kg") for i in range(4)] + [("odd", i, "2", "2 kg" if i % 2 else "3 kg") for i in range(20)]
    df = spark.createDataFrame(rows, "dataset_id string, _source_row long, weight string, variant_uom_text string")
    got = {r.dataset_id: (r.checked, r.agreed, r.weight_unit) for r in grid.infer_weight_unit(df).collect()}
    assert got == {"d": (20, 20, "KG"), "few": (4, 4, None), "odd": (20, 10, None)}
