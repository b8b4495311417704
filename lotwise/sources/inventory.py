"""A dirty inventory made from star-schema tables: one row a line item, as a stock sheet would list it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Product words and pack texts, dealt to parts by key.
PRODUCTS = [
    ("Chakki Atta", "10 kg"), ("Basmati Rice", "5 kg"), ("Toor Dal", "1 kg"), ("Mustard Oil", "500 ml"), ("Cow Ghee", "1 L"), ("Brown Sugar", "1 kg"),
    ("Rock Salt", "200 g"), ("Turmeric Masala", "100 g"), ("Green Tea", "25 pcs"), ("Instant Coffee", "50 g"), ("Marie Biscuit", "6 x 12.5 g"), ("Potato Chips", "52 g"),
    ("Mango Juice", "24 x 250 ml"), ("Kaju Katli Mithai", "400 g"), ("Dark Chocolate", "50 g"), ("Almonds", "500 g"), ("Hakka Noodles", "4 x 70 g"), ("Macaroni Pasta", "500 g"),
    ("Tomato Ketchup", "950 g"), ("Mango Pickle", "300 g"), ("Paneer", "200 g"), ("Corn Flakes", "300 g"), ("Besan Flour", "500 g"), ("Whey Protein Powder", "1 kg"),
    ("Dog Food", "3 kg"), ("Incense Sticks", "1 pack"), ("Baby Diaper", "20 pcs"), ("LED Bulb", "9 w"), ("Drill Machine", "1 unit"), ("Engine Oil", "3 L"),
    ("Cotton Shirt", "1 pc"), ("Office Chair", "1 unit"), ("Mystery Novel", "1 unit"), ("Floor Cleaner", "975 ml"), ("Coffee Mug", "1 unit"), ("Hair Shampoo", "340 ml"),
    ("Lathe Machine", "1 unit"), ("Teddy Bear", "1 unit"), ("Gel Pen", "10 pcs"), ("Yoga Mat", "1 pair"), ("Garden Hose", "10 m"), ("Rice Bran Oil", "5 L"),
]

_WORDS = ", ".join(f"({i}, '{word}', '{pack}')" for i, (word, pack) in enumerate(PRODUCTS))

#: Plain SQL over lineitem, part, supplier and nation that Spark and other engines read alike.
INVENTORY_SQL = f"""
SELECT 'ds' || CAST(l_suppkey % 4 AS STRING) AS dataset_id,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Non_saleable' WHEN l_returnflag = 'R' THEN 'Bad RTV ( Dump )'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 'atta' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'General'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Near Expiry Stock' ELSE 'Saleable' END AS _sheet_name,
  l_orderkey * 8 + l_linenumber AS _source_row,
  CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN '  ' || upper(word) || '   ' || p_name || ' ' ELSE word || ' ' || p_name || CASE WHEN l_partkey % 4 = 0 THEN ' ' || pack ELSE '' END END AS name,
  CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 5 = 1 THEN replace(lower(p_brand), '#', ' ') || ' pvt. ltd.' WHEN l_partkey % 5 = 2 THEN 'The ' || replace(p_brand, '#', ' ') || ' Inc' ELSE replace(p_brand, '#', ' ') END AS brand,
  CASE WHEN l_suppkey % 31 = 0 THEN '' ELSE lower(n_name) || ' depot' END AS entity_name,
  CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE 'SKU' || CAST(l_partkey AS STRING) END AS item_id,
  CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(l_partkey AS STRING), 12, '8') WHEN l_partkey % 3 = 1 THEN '' ELSE CAST(l_partkey AS STRING) END AS upc,
  CAST(l_partkey * 10 + p_size % 3 AS STRING) AS variant_id,
  CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 7 = 1 THEN pack || ' - Rs ' || CAST(p_size AS STRING) || '.5' WHEN l_orderkey % 7 = 2 THEN pack || ' - ' || CAST(p_size * 10 AS STRING) ELSE pack END AS variant_uom_text,
  CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 'INR 1,' || lpad(CAST(p_size AS STRING), 3, '0') || '.50' WHEN l_partkey % 43 = 0 THEN '0' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS variant_mrp,
  CASE WHEN l_orderkey % 37 = 0 THEN '0' WHEN l_orderkey % 53 = 0 THEN 'n/a' WHEN l_orderkey % 59 = 0 THEN '-3' ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) END AS qty,
  CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 6 = 1 THEN '0' WHEN (l_orderkey + l_linenumber) % 6 = 2 THEN '₹ ' || CAST(CAST(floor(l_extendedprice) AS INT) AS STRING) || '.25'
       WHEN l_orderkey % 61 = 0 THEN '-50' ELSE CAST(CAST(floor(l_extendedprice) AS INT) AS STRING) END AS value,
  (l_orderkey + l_linenumber) % 12 = 1 AS value_is_numeric,
  CASE l_orderkey % 8 WHEN 0 THEN '2 kg' WHEN 1 THEN '750 g' WHEN 2 THEN '1.5' WHEN 3 THEN '1 l' WHEN 4 THEN '-' ELSE NULL END AS weight,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN '24 kg' WHEN 1 THEN '5000 g' WHEN 2 THEN '12' ELSE NULL END AS total_weight,
  CASE l_partkey % 8 WHEN 0 THEN 'Grocery' WHEN 1 THEN 'saleable' WHEN 2 THEN 'Lot-15' WHEN 3 THEN 'Electronics' WHEN 4 THEN 'garden tools' WHEN 5 THEN 'Munchies' ELSE '' END AS l0,
  CASE WHEN l_orderkey % 19 = 0 THEN 'Non-Saleable/Stock' WHEN l_orderkey % 23 = 0 THEN 'Saleable/Active' ELSE '' END AS item_type,
  CASE l_orderkey % 9 WHEN 0 THEN 'Non-Sellable' WHEN 1 THEN 'Active' WHEN 2 THEN 'not available' WHEN 3 THEN 'N/A' WHEN 4 THEN 'Good_Condition' ELSE '' END AS inventory_status,
  CASE l_orderkey % 10 WHEN 0 THEN 'Bad mark not available' WHEN 1 THEN 'unsaleable lot' WHEN 2 THEN 'ready for sale' WHEN 3 THEN 'Packaging damaged' ELSE '' END AS remarks,
  CASE WHEN l_orderkey % 47 = 0 THEN 'inactive' ELSE '' END AS condition,
  '' AS disposition
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN (VALUES {_WORDS}) AS w(k, word, pack) ON l_partkey % {len(PRODUCTS)} = k
"""


#: A table of fewer bytes than this for each task may be read by few tasks.
SPLIT_BYTES = 4 << 20


def _bytes(spark: SparkSession, files: list[str]) -> int:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty inventory over the tables in a folder.

    The JVM compiles no method of over 8,000 bytes. Rules over many columns made one such method of a whole stage, which was
    then interpreted row by row; with this limit Spark makes smaller ones.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    sql, tables = INVENTORY_SQL, {}
    for name in ("lineitem", "part", "supplier", "nation"):
        tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        tasks = spark.sparkContext.defaultParallelism
        if name == "lineitem" and len(files := tables[name].inputFiles()) < tasks and _bytes(spark, files) < tasks * SPLIT_BYTES:
            tables[name] = tables[name].repartition(tasks)  # few small files: else few tasks do all rules; large ones are split as they are read
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **tables)
