"""Image archives that may serve as a held-out site, with what is known of each and how well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, name string, country string, n_images int, both_classes boolean, licence string, access string, url string, independent_of array<string>, verdict string, evidence map<string, string>"
_NITRD = "https://www.kaggle.com/datasets/vbookshelf/da-and-db-tb-chest-x-ray-datasets"
_KNOWN = ["montgomery", "shenzhen", "niaid", "rsna", "belarus"]
_REPORTED = {"n_images": "reported", "both_classes": "reported", "institution": "reported", "licence": "unknown"}

# The archives, from most to least useful; licence and access by short codes, evidence by field.
SOURCES = (
    ("nitrd_da", "NITRD set DA", "India", 156, True, "research", "open", _NITRD, ["montgomery", "shenzhen", "rsna"], "usable", _REPORTED),
    ("nitrd_db", "NITRD set DB", "India", 150, True, "research", "open", _NITRD, ["montgomery", "shenzhen", "rsna"], "usable", _REPORTED),
    ("tbx11k", "TBX11K", "China", 11200, True, "cc-by-4", "link", "https://github.com/yun-liu/Tuberculosis", [], "usable_with_caveats",
     {"n_images": "verified", "class_note": "verified", "licence": "verified", "native_resolution": "verified", "institution": "unknown"}),
    ("vindr_cxr", "VinDr-CXR", "Vietnam", 18000, True, "credentialed", "agreement", "https://physionet.org/content/vindr-cxr/1.0.0/", _KNOWN, "usable_with_caveats",
     {"n_images": "verified", "class_note": "verified", "licence": "verified", "institution": "verified", "both_classes": "verified"}),
    ("padchest", "PadChest", "Spain", 160000, True, "research", "registration", "https://bimcv.cipf.es/bimcv-projects/padchest/", _KNOWN, "usable_with_caveats",
     {"n_images": "verified", "institution": "verified", "class_note": "reported"}),
    ("kaggle_tb_aggregate", "Tuberculosis (TB) Chest X-ray Database (Qatar/Dhaka)", "mixed", 4200, True, "cc-by-4", "open",
     "https://www.kaggle.com/datasets/tawsifurrahman/tuberculosis-tb-chest-xray-dataset", [], "not_a_fold", {"class_note": "reported", "overlap_risk": "verified"}),
    ("niaid_tbportals", "NIAID TB Portals", "multi", 3000, False, "agreement", "agreement", "https://data.tbportals.niaid.nih.gov/", ["montgomery", "shenzhen", "rsna"], "not_a_fold", {"both_classes": "verified"}),
)


def source_registry(spark: SparkSession) -> DataFrame:
    """One row an archive, with the fields that nobody has verified, in order."""
    unverified = F.array_sort(F.map_keys(F.map_filter("evidence", lambda _, v: v != "verified")))
    return spark.createDataFrame(list(SOURCES), SCHEMA).withColumn("unverified", unverified)


def candidate_folds(spark: SparkSession) -> DataFrame:
    return source_registry(spark).where(F.col("verdict").isin("usable", "usable_with_caveats"))
