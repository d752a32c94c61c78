"""The named server functions with their arguments, for callers that know them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from ..operators.relational import first_by
from ..operators.search import Catalog
from . import names as N


def _asked(catalog: DataFrame, texts: list[str]) -> DataFrame:
    rows = catalog.sparkSession.createDataFrame(list(enumerate(texts)), "query_index int, text string")
    return rows.select("query_index", N.normal_plain(F.col("text")).alias("norm"))


def match_products_trgm_batch(catalog: DataFrame, query_texts: list[str]) -> DataFrame:
    """query_index, id, price, similarity, place of up to 1000 offers for each text. catalog: (id, price, norm)."""
    return Catalog(catalog).by_grams(_asked(catalog, query_texts).select("query_index", N.trigrams(F.col("norm")).alias("grams"))).drop("by_price")


def match_products_axe_batch(catalog: DataFrame, query_texts: list[str], match_limit: int = 1000) -> DataFrame:
    """query_index, id, price, layer, score, place; scores compare within a layer only."""
    return Catalog(catalog).layered(_asked(catalog, query_texts), match_limit)


def type_lander_by_slug(products: DataFrame, slug: str, least_priced: int = 5, samples: int = 10) -> DataFrame:
    """One row of counts, prices and samples; none for a lander with too few priced products. products: (id, slug, name, price, created)."""
    own = products.where(F.col("slug") == slug)
    p = F.col("price")
    out = own.groupBy("slug").agg(F.count(F.lit(1)).alias("product_count"), F.count_if(p > 0).alias("priced_count"), F.avg(F.when(p > 0, p)).alias("avg_price"), F.min(F.when(p > 0, p)).alias("min_price"), F.max(p).alias("max_price"))
    best = first_by(own.where(p > 0), ["slug"], [F.desc_nulls_last("created"), F.col("id")], samples, "place")
    shown = best.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "name", "price"))), lambda x: x.dropFields("place")).alias("sample"))
    return out.join(shown, "slug").where(F.col("priced_count") >= least_priced)


def type_lander_slugs(products: DataFrame) -> DataFrame:
    return products.select(F.trim("slug").alias("slug")).where("slug <> ''").distinct()


def type_lander_hub_list(products: DataFrame) -> DataFrame:
    """Landers by volume."""
    p = F.col("price")
    return products.where("trim(slug) <> ''").groupBy("slug").agg(F.count(F.lit(1)).alias("product_count"), F.count_if(p > 0).alias("priced_count"), F.avg(F.when(p > 0, p)).alias("avg_price")).orderBy(F.desc("product_count"), "slug")


@udtf
class HubList:
    """The landers of a table of products (slug, price) for SQL: dealt by lander, of which only sums are kept."""

    @staticmethod
    def analyze(products: AnalyzeArgument) -> AnalyzeResult:
        if not products.isTable:
            raise ValueError("pass the products as TABLE(...)")
        missing = {"slug", "price"} - {f.name for f in products.dataType.fields}
        if missing:
            raise ValueError(f"the products lack {sorted(missing)}")
        schema = StructType().add("slug", "string").add("product_count", "long").add("priced_count", "long").add("avg_price", "double")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("slug")], select=[SelectedColumn("slug"), SelectedColumn("price")])

    def __init__(self):
        self.slug, self.n, self.priced, self.total = None, 0, 0, 0

    def eval(self, row):
        self.slug = row["slug"]
        self.n += 1
        if row["price"] is not None and row["price"] > 0:
            self.priced, self.total = self.priced + 1, self.total + row["price"]

    def terminate(self):
        if self.n and (self.slug or "").strip(" "):
            yield self.slug, self.n, self.priced, self.total / self.priced if self.priced else None


@udtf
class Slugs:
    """The distinct slugs of a table of products for SQL, blanks dropped."""

    @staticmethod
    def analyze(products: AnalyzeArgument) -> AnalyzeResult:
        if not products.isTable:
            raise ValueError("pass the products as TABLE(...)")
        return AnalyzeResult(StructType().add("slug", "string"), partitionBy=[PartitioningColumn("trim(slug)")], select=[SelectedColumn("trim(slug)", alias="slug")])

    def __init__(self):
        self.slug = None

    def eval(self, row):
        self.slug = row["slug"]

    def terminate(self):
        if self.slug:
            yield (self.slug,)


@udtf
class Lander:
    """One lander of a table of products (id, slug, name, price) for SQL: counts and prices, none if too few products have a price."""

    @staticmethod
    def analyze(products: AnalyzeArgument, p_slug: AnalyzeArgument, least_priced: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not products.isTable or p_slug.value is None:
            raise ValueError("pass the products as TABLE(...) and a constant slug")
        schema = StructType().add("slug", "string").add("product_count", "long").add("priced_count", "long").add("min_price", "long").add("max_price", "long")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("slug")], select=[SelectedColumn("slug"), SelectedColumn("price")])

    def __init__(self):
        self.slug, self.n, self.priced, self.least, self.most, self.need = None, 0, 0, None, None, 5

    def eval(self, row, p_slug, least_priced=5):
        if row["slug"] != p_slug:
            return
        self.slug, self.need, self.n, price = p_slug, least_priced, self.n + 1, row["price"]
        if price is not None:
            self.most = price if self.most is None else max(self.most, price)
            if price > 0:
                self.priced += 1
                self.least = price if self.least is None else min(self.least, price)

    def terminate(self):
        if self.n and self.priced >= self.need:
            yield self.slug, self.n, self.priced, self.least, self.most


#: The names by which SQL calls them: SELECT ... FROM type_lander_hub_list(TABLE(products)).
TABLE_FUNCTIONS = {"type_lander_hub_list": HubList, "type_lander_slugs": Slugs, "type_lander_by_slug": Lander}


def register(spark: SparkSession) -> None:
    """Make the table functions callable in the SQL of a session."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
