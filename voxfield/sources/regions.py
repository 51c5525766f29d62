"""Regions and their sources as a dimension: categories, order, weights, what runs by default and what only on request.

A dimension has a row for each source of a region: region, name, languages, place (from 0, as listed), source, category, priority, persona_value,
journey_value, stance, default_enabled, excluded. It is as small as its file. Of a source listed twice in a region the first place counts
in `tag`; `violations` names the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxfield.operators.relations import CATEGORIES

STANCES = ["allowed", "allowed_with_conditions", "silent", "prohibited", "unknown"]
SCHEMA = "region string, name string, languages array<string>, place int, source string, category string, priority int, persona_value int, journey_value int, stance string, default_enabled boolean, excluded boolean"

# Each region with its name and languages, then its sources: category, priority, value for personas, value for journeys, stance;
# "opt-in" runs only when it is named, "excluded" needs a key or a paid service and never runs.
REGIONS = """
HK: Hong Kong: zh-HK yue en
lihkg forums 1 5 3 silent
discuss_hk forums 2 4 3 silent
reddit_old forums 3 4 4 allowed_with_conditions
baby_kingdom forums 3 4 4 silent
openrice reviews 1 3 5 prohibited opt-in
trustpilot reviews 2 3 4 prohibited opt-in
app_store_hk reviews 3 3 4 silent
google_play_hk reviews 4 3 4 prohibited opt-in
hk01 news_comments 1 3 2 prohibited opt-in
youtube_html video_comments 1 3 3 prohibited opt-in
yahoo_news_hk news_comments 2 2 2 silent
quora_hk qa 1 3 4 prohibited opt-in
medium_hk blogs 1 5 4 prohibited opt-in
hk_lifestyle_blogs blogs 2 4 4 silent
google_serp blogs 3 1 1 prohibited opt-in
threads_hk social 1 3 2 prohibited opt-in
instagram_public social 2 3 2 prohibited opt-in
xiaohongshu_hk social 3 4 4 prohibited opt-in
google_maps_hk reviews 99 3 5 allowed_with_conditions excluded
youtube_hk video_comments 99 3 3 allowed_with_conditions excluded
reddit_hongkong qa 99 4 4 allowed_with_conditions excluded
facebook_hk_groups social 99 4 3 prohibited opt-in excluded
US: United States: en
reddit_old forums 1 4 4 allowed_with_conditions
trustpilot reviews 1 3 5 prohibited opt-in
yelp_html reviews 2 3 5 prohibited opt-in
app_store_us reviews 3 3 4 silent
google_play_us reviews 4 3 4 prohibited opt-in
youtube_html video_comments 1 3 3 prohibited opt-in
quora qa 1 3 4 prohibited opt-in
medium blogs 1 5 4 prohibited opt-in
yahoo_news_us news_comments 1 3 2 silent
reddit forums 99 4 4 allowed_with_conditions excluded
youtube video_comments 99 3 3 allowed_with_conditions excluded
UK: United Kingdom: en
reddit forums 99 4 4 allowed_with_conditions excluded
trustpilot reviews 1 3 5 prohibited opt-in
youtube video_comments 99 3 3 allowed_with_conditions excluded
quora qa 1 3 4 prohibited opt-in
AU: Australia: en
reddit forums 99 4 4 allowed_with_conditions excluded
trustpilot reviews 1 3 5 prohibited opt-in
youtube video_comments 99 3 3 allowed_with_conditions excluded
quora qa 1 3 4 prohibited opt-in
CN: China (Mainland): zh-CN
xiaohongshu social 1 4 4 prohibited opt-in
weibo social 2 3 2 prohibited opt-in
zhihu qa 1 4 4 prohibited opt-in
dianping reviews 1 3 5 prohibited opt-in
douyin_comments video_comments 1 2 2 prohibited opt-in
TW: Taiwan: zh-TW
ptt forums 1 5 3 allowed_with_conditions
dcard forums 2 5 4 silent
mobile01 forums 3 4 4 silent
google_play_tw reviews 1 3 4 prohibited opt-in
app_store_tw reviews 2 3 4 silent
yahoo_news_tw news_comments 1 3 2 silent
youtube_html video_comments 1 3 3 prohibited opt-in
quora_tw qa 1 3 4 prohibited opt-in
medium_tw blogs 1 5 4 prohibited opt-in
youtube video_comments 99 3 3 allowed_with_conditions excluded
JP: Japan: ja
five_ch forums 1 4 3 silent
yahoo_japan_reviews reviews 1 3 5 silent
cosme reviews 2 4 5 silent
tabelog reviews 3 3 5 prohibited opt-in
google_play_jp reviews 4 3 4 prohibited opt-in
app_store_jp reviews 5 3 4 silent
yahoo_news_jp news_comments 1 3 2 silent
youtube_html video_comments 1 3 3 prohibited opt-in
quora_jp qa 1 3 4 prohibited opt-in
medium_jp blogs 1 5 4 prohibited opt-in
twitter_jp social 99 3 2 prohibited opt-in excluded
youtube video_comments 99 3 3 allowed_with_conditions excluded
KR: South Korea: ko
dcinside forums 1 4 3 silent
coupang_reviews reviews 1 2 5 prohibited opt-in
naver_blog blogs 1 5 4 prohibited opt-in
ID: Indonesia: id
kaskus forums 1 5 3 silent
reddit_indonesia forums 99 4 4 allowed_with_conditions excluded
shopee_reviews reviews 1 2 5 prohibited opt-in
lazada_reviews reviews 2 2 5 prohibited opt-in
TH: Thailand: th
pantip forums 1 5 4 silent
shopee_reviews reviews 1 2 5 prohibited opt-in
lazada_reviews reviews 2 2 5 prohibited opt-in
VN: Vietnam: vi
tinhte forums 1 4 4 silent
shopee_reviews reviews 1 2 5 prohibited opt-in
lazada_reviews reviews 2 2 5 prohibited opt-in
PH: Philippines: en tl
reddit_philippines forums 99 4 4 allowed_with_conditions excluded
shopee_reviews reviews 1 2 5 prohibited opt-in
lazada_reviews reviews 2 2 5 prohibited opt-in
MY: Malaysia: ms en zh
lowyat forums 1 4 4 silent
reddit_malaysia forums 99 4 4 allowed_with_conditions excluded
shopee_reviews reviews 1 2 5 prohibited opt-in
SG: Singapore: en zh ms ta
hardwarezone forums 1 4 3 silent
reddit_singapore forums 99 4 4 allowed_with_conditions excluded
shopee_reviews reviews 1 2 5 prohibited opt-in
DE: Germany: de
reddit_de forums 99 4 4 allowed_with_conditions excluded
trustpilot reviews 1 3 5 prohibited opt-in
gutefrage qa 1 3 4 silent
FR: France: fr
reddit_fr forums 99 4 4 allowed_with_conditions excluded
doctissimo forums 1 4 4 silent
trustpilot reviews 1 3 5 prohibited opt-in
ES: Spain: es
reddit_es forums 99 4 4 allowed_with_conditions excluded
forocoches forums 1 4 3 silent
trustpilot reviews 1 3 5 prohibited opt-in
IT: Italy: it
reddit_it forums 99 4 4 allowed_with_conditions excluded
trustpilot reviews 1 3 5 prohibited opt-in
NL: Netherlands: nl
reddit_nl forums 99 4 4 allowed_with_conditions excluded
tweakers forums 1 4 4 silent
trustpilot reviews 1 3 5 prohibited opt-in
"""


def parse(text: str = REGIONS) -> list[tuple]:
    """The rows of a listing such as REGIONS."""
    rows, head, place = [], ("", "", []), 0
    for line in text.strip().splitlines():
        if ": " in line:
            region, name, languages = line.split(": ")
            head, place = (region, name, languages.split()), 0
            continue
        source, category, *numbers, stance = line.split()[:6]
        flags = line.split()[6:]
        rows.append((*head, place, source, category, *map(int, numbers), stance, "opt-in" not in flags, "excluded" in flags))
        place += 1
    return rows


def regions(spark: SparkSession, text: str = REGIONS) -> DataFrame:
    return spark.createDataFrame(parse(text), SCHEMA)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects, one for each region: region_id, display_name, primary_languages and sources. A source that doesn't say so runs by default,
    isn't excluded, and has an unknown stance."""
    one = "source_id string, category string, priority int, persona_value int, journey_value int, tos_scraping_stance string, default_enabled boolean, excluded_by_constraint boolean"
    raw = spark.read.schema(f"region_id string, display_name string, primary_languages array<string>, sources array<struct<{one.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>").json(path, multiLine=True)
    s = raw.select(F.col("region_id").alias("region"), F.col("display_name").alias("name"), F.col("primary_languages").alias("languages"), F.posexplode("sources").alias("place", "s"))
    return s.select(
        "region", "name", "languages", "place", F.col("s.source_id").alias("source"), "s.category", "s.priority", "s.persona_value", "s.journey_value", F.coalesce("s.tos_scraping_stance", F.lit("unknown")).alias("stance"),
        F.coalesce("s.default_enabled", F.lit(True)).alias("default_enabled"), F.coalesce("s.excluded_by_constraint", F.lit(False)).alias("excluded"),
    )


def violations(dim: DataFrame) -> DataFrame:
    """(region, source, problem): a prohibited source that runs by default, an unknown category or stance, a value outside 1 to 5, a source listed before."""
    inside = lambda c: F.coalesce(F.col(c).between(1, 5), F.lit(False))
    before = F.row_number().over(Window.partitionBy("region", "source").orderBy("place")) > 1
    problems = [
        ((F.col("stance") == "prohibited") & F.col("default_enabled"), "prohibited but runs by default"),
        (~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "unknown category"),
        (~F.coalesce(F.col("stance").isin(STANCES), F.lit(False)), "unknown stance"),
        (~inside("persona_value"), "persona_value outside 1 to 5"),
        (~inside("journey_value"), "journey_value outside 1 to 5"),
        (F.col("_before"), "listed before"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in problems]))
    return dim.withColumn("_before", before).select("region", "source", F.explode(found).alias("problem"))


def by_category(dim: DataFrame, include_excluded: bool = False, include_opt_in: bool = False) -> DataFrame:
    """The sources of each category in the order they are tried (`rank`, from 1): by priority, then as listed."""
    rows = dim.where((~F.col("excluded") | F.lit(include_excluded)) & (F.col("default_enabled") | F.lit(include_opt_in)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("region", "category").orderBy("priority", "place")))


def category_order(category: Column) -> Column:
    """Its place among the categories, from 1; 0 for others."""
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


def default_sources(dim: DataFrame) -> DataFrame:
    """What runs where no source is named, in order (`run`, from 1): category by category, each by priority. Categories that aren't known don't run."""
    rows = by_category(dim).withColumn("_c", category_order(F.col("category"))).where("_c > 0")
    return rows.withColumn("run", F.row_number().over(Window.partitionBy("region").orderBy("_c", "rank"))).drop("_c", "rank")


def listing(dim: DataFrame) -> DataFrame:
    """A row for each region: how many sources it has, how many run by default, on request or never, and in which categories some run."""
    runs = ~F.col("excluded") & F.col("default_enabled")
    return dim.groupBy("region").agg(
        F.first("name").alias("name"), F.array_join(F.first("languages"), ",").alias("languages"), F.count("*").alias("sources"), F.count_if(runs).alias("enabled"),
        F.count_if(~F.col("excluded") & ~F.col("default_enabled")).alias("opt_in"), F.count_if("excluded").alias("excluded"), F.array_join(F.array_sort(F.collect_set(F.when(runs, F.col("category")))), ",").alias("categories"),
    )


def tag(posts: DataFrame, dim: DataFrame, *columns: str) -> DataFrame:
    """posts (region, source, ...) with these columns of their source, null for unknown ones. Spark broadcasts dim while it is below its threshold."""
    first = dim.groupBy("region", "source").agg(*[F.min_by(c, "place").alias(c) for c in columns])
    return posts.join(first, ["region", "source"], "left")


def weigh(counts: DataFrame, dim: DataFrame, value: str = "persona_value") -> DataFrame:
    """counts (region, source, n) -> (region, category, posts, weight, share): posts weighed by what their sources are worth for personas or journeys,
    and the category's share of its region's weight. Posts of unknown sources have no weight and no category."""
    rows = tag(counts, dim, "category", value).groupBy("region", "category")
    out = rows.agg(F.sum("n").alias("posts"), F.sum(F.col("n") * F.coalesce(F.col(value), F.lit(0))).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("region"))
    return out.withColumn("share", F.when(total > 0, F.round(F.col("weight") / total, 4)).otherwise(0.0))
