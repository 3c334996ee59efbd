"""The airport dimension shipped with the reference (20 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faresight.schema import AIRPORT_SCHEMA

# --- fixed values (the reference's airport list, file order) --------------
AIRPORTS = [
    ("SGN", "Tp. Hồ Chí Minh", "Sân bay quốc tế Tân Sơn Nhất", "Việt Nam"),
    ("HAN", "Hà Nội", "Sân bay quốc tế Nội Bài", "Việt Nam"),
    ("DAD", "Đà Nẵng", "Sân bay quốc tế Đà Nẵng", "Việt Nam"),
    ("CXR", "Khánh Hòa", "Sân bay quốc tế Cam Ranh", "Việt Nam"),
    ("PQC", "Phú Quốc", "Sân bay quốc tế Phú Quốc", "Việt Nam"),
    ("VDO", "Quảng Ninh", "Sân bay quốc tế Vân Đồn", "Việt Nam"),
    ("HUI", "Huế", "Sân bay Phú Bài", "Việt Nam"),
    ("HPH", "Hải Phòng", "Sân bay Cát Bi", "Việt Nam"),
    ("VDH", "Đồng Hới", "Sân bay Đồng Hới", "Việt Nam"),
    ("VII", "Vinh", "Sân bay Vinh", "Việt Nam"),
    ("THD", "Thanh Hóa", "Sân bay Thọ Xuân", "Việt Nam"),
    ("DLI", "Đà Lạt", "Sân bay Liên Khương", "Việt Nam"),
    ("BMV", "Buôn Ma Thuột", "Sân bay Buôn Ma Thuột", "Việt Nam"),
    ("PLE", "Pleiku", "Sân bay Pleiku", "Việt Nam"),
    ("UIH", "Quy Nhơn", "Sân bay Phù Cát", "Việt Nam"),
    ("TBB", "Tuy Hòa", "Sân bay Tuy Hòa", "Việt Nam"),
    ("VCA", "Cần Thơ", "Sân bay Cần Thơ", "Việt Nam"),
    ("CAH", "Cà Mau", "Sân bay Cà Mau", "Việt Nam"),
    ("VKG", "Rạch Giá", "Sân bay Rạch Giá", "Việt Nam"),
    ("DIN", "Điện Biên", "Sân bay Điện Biên Phủ", "Việt Nam"),
]
# ---------------------------------------------------------------------------


AIRPORT_ROWS = len(AIRPORTS)


def airports_df(spark: SparkSession) -> DataFrame:
    """The built-in airport list as a (broadcastable) dimension table."""
    return spark.createDataFrame(AIRPORTS, AIRPORT_SCHEMA)
