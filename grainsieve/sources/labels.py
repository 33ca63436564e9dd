"""Label sources: four sample labels, and labels made from the part table by integer arithmetic for tests at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.verify import SOURCE
from ..runtime import spread, table

# The samples.
SAMPLES = [
    ("s1", "0蔗糖", "水、果葡糖浆、白砂糖、浓缩柠檬汁、柠檬酸、食用香精", "能量 180kJ, 蛋白质 0g, 脂肪 0g, 碳水化合物 10.6g, 糖 0g, 钠 20mg"),
    ("s2", "高钙", "水、浓缩苹果汁、柠檬酸、食用香精", "能量 120kJ, 钙 150mg, 钠 15mg"),
    ("s3", "无添加", "水、白砂糖、浓缩柠檬汁、柠檬酸、山梨酸钾、食用香精", "能量 180kJ, 糖 9g, 钠 12mg"),
    ("s4", "0脂肪", "水、赤藓糖醇、柠檬酸、食用香精", "能量 20kJ, 脂肪 0g, 糖 0g, 钠 5mg"),
]

VOCAB = ["水", "白砂糖", "果葡糖浆", "小麦粉", "食用盐", "柠檬酸", "山梨酸钾", "食用香精", "赤藓糖醇", "脱脂乳粉", "碳酸钙", "大豆油", "鸡蛋", "花生", "龙舌兰糖浆", "浓缩柠檬汁饮料", "副干酪乳杆菌", "阿斯巴甜", "菊粉", "卡拉胶", "复配酸度调节剂", "风味发酵乳（水、脱脂乳粉、白砂糖）", "单，双甘油脂肪酸酯"]
CLAIMS = ["0蔗糖", "高钙", "无添加剂", "0脂肪", "低钠", "纯天然", "高膳食纤维", "轻负担", "儿童专用", "非油炸", "口感好", "不添加防腐剂", "高蛋白", "低糖", "0卡", "纯正", "更健康", "无糖"]
BASES = ["100g", "100mL", "30g", "份"]


def samples(spark: SparkSession) -> DataFrame:
    rows = [(i, t, [(x.split(" ")[0], *_amount(x.split(" ")[1]), "100mL", None) for x in n.split(", ")], [c]) for i, c, t, n in SAMPLES]
    return spark.createDataFrame(rows, "label_id string, ingredients_text string, nutrition array<struct<name:string,value:string,unit:string,basis:string,nrv:string>>, claims array<string>")


def _amount(text: str) -> tuple[str, str]:
    value = text.rstrip("abcdefghijklmnopqrstuvwxyzJ")
    return value, text[len(value) :]


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each part: everything about it follows from p_partkey."""
    k = F.col("p_partkey")
    words, claims, bases = (F.array(*map(F.lit, x)) for x in (VOCAB, CLAIMS, BASES))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), 3 + k % 6), lambda i: F.get(words, ((k * 7 + i * 13) % len(VOCAB)).cast("int")))
    basis = F.get(bases, (k % 4).cast("int"))

    def item(name: str, value, unit: str):
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), basis.alias("basis"), F.lit(None).cast("string").alias("nrv"))

    def tenth(x):
        return F.concat((F.floor(x / 10)).cast("string"), F.lit("."), (x % 10).cast("string"))

    nutrition = F.array(item("糖", tenth(k * 37 % 300), "g"), item("钠", (k * 53 % 900).cast("string"), "mg"), item("脂肪", tenth(k * 17 % 250), "g"), item("钙", (k * 29 % 400).cast("string"), "mg"), item("蛋白质", tenth(k * 11 % 200), "g"))
    made = spread(table(spark, sf_dir, "part").where(k.isNotNull()).select("p_partkey", "p_name")).select(
        F.concat(F.lit("L"), k.cast("string")).alias("label_id"), F.col("p_name").alias("product_name"), F.array_join(parts, "、").alias("ingredients_text"), nutrition.alias("nutrition"),
        F.array(F.get(claims, (k % len(CLAIMS)).cast("int"))).alias("claims"), ((50 + k % 50) / F.lit(100.0)).cast("double").alias("confidence"), k.alias("key"),
    )
    have = set(made.columns)
    return made.select(*((F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in SOURCE.fields), "key")
