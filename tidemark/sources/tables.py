"""Sources and sinks: a registry of named tables, corruption and noise generators, long-tail samples, experiment logs.

Named datasets are partitioned Parquet tables (dataset, split[, corruption, intensity], id, features, label); the
registry maps a name to the partition filters that select it, so that reading one prunes all other partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Names of the datasets, in groups by how a table of theirs is selected.
PLAIN = ("cifar10", "cifar100", "stl10", "svhn", "mnist", "fashion_mnist", "english_chars", "isun", "lsun_c", "lsun_r", "tiny_imagenet_c", "tiny_imagenet_r", "tiny_imagenet", "textures", "places365", "stanford_cars", "oxford_pets", "imagenet", "imagenet_train", "imagenet1k", "ilsvrc2012", "imagenet_a", "imagenet_o", "imagenet_r", "openimage_o", "mos_inaturalist", "mos_places365", "mos_sun", "inaturalist", "sun", "ninco", "ninco_full", "ssb_easy", "ssb_hard", "wilds_iwildcam", "wilds_fmow", "wilds_camelyon17", "wilds_rxrx1", "wilds_poverty", "wilds_globalwheat")
CORRUPTED = ("cifar10_c", "cifar100_c", "mnist_c", "imagenet1k_c", "imagenet_c", "imagenet_c_npz")
CORRUPTIONS = ("gaussian_noise", "shot_noise", "impulse_noise", "defocus_blur", "glass_blur", "motion_blur", "zoom_blur", "snow", "frost", "fog", "brightness", "contrast", "elastic_transform", "pixelate", "jpeg_compression", "speckle_noise", "gaussian_blur", "spatter", "saturate")
NOISES = ("gaussian", "uniform", "blobs", "rademacher")

_PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def register_dataset(name: str) -> Callable:
    """Registers provider(spark, root, split, **options) under a name; a second one is an error."""

    if name in _PROVIDERS:
        raise ValueError(f"dataset {name} is registered already")

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _PROVIDERS[name] = fn
        return fn

    return add


def list_datasets() -> list[str]:
    return sorted({*PLAIN, *CORRUPTED, *NOISES, *_PROVIDERS})


def read_dataset(spark: SparkSession, name: str, root: str, split: str = "train", corruption: str | None = None, intensity: int | None = None, **options) -> DataFrame:
    """Rows of a named dataset in the partitioned table at root, or of a registered provider or generator."""
    if name in _PROVIDERS:
        return _PROVIDERS[name](spark, root, split, **options)
    if name in NOISES:
        return noise(spark, name, **options)
    if name not in PLAIN and name not in CORRUPTED:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(list_datasets())}")
    out = spark.read.parquet(root).where((F.col("dataset") == name) & (F.col("split") == split))
    if name in CORRUPTED and corruption and corruption != "all":
        if corruption not in CORRUPTIONS and name != "mnist_c":
            raise ValueError(f"unknown corruption {corruption}")
        out = out.where(F.col("corruption") == corruption)
    return out if intensity is None else out.where(F.col("intensity") == intensity)


def write_dataset(df: DataFrame, root: str, *partitions: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*(partitions or ("dataset", "split"))).parquet(root)


def delete_dataset(spark: SparkSession, root: str) -> bool:
    """Removes the table's files through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def image_folder(spark: SparkSession, root: str, single_class: bool = False) -> DataFrame:
    """(path, content, class_name, label) of files in class folders; labels are the classes' alphabetical places, or 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    if single_class:
        return named.select("path", "content", "class_name", F.lit(0).alias("label"))
    classes = named.select("class_name").distinct().withColumn("label", F.row_number().over(Window.orderBy("class_name")) - 1)
    return named.join(F.broadcast(classes), "class_name").select("path", "content", "class_name", "label")


def annotated(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Files (path, ...) with the class that a tab-separated annotation table (file, class, ...) gives their name."""
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(annotations.select("file", "class_name"), "file")


def subset_logits(z: Column, mask: Column) -> Column:
    """The logits of the classes whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(z.alias("v"), mask.alias("m")), lambda q: q["m"]), lambda q: q["v"])


def unit(seed: str, *parts: Column) -> Column:
    """A reproducible uniform in [0, 1): the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def noise(spark: SparkSession, kind: str, n: int = 10_000, dims: int = 16, seed: str = "noise") -> DataFrame:
    """(id, features, label): label -1; gaussian clips N(0, 1) + .5 to [0, 1]; blobs are smoothed and cut at .75 along the vector."""
    ids = spark.range(n).select("id", F.sequence(F.lit(0), F.lit(dims - 1)).alias("d"))

    def u(purpose: str) -> Callable[[Column], Column]:
        return lambda j: unit(seed, F.lit(kind), F.lit(purpose), F.col("id"), j)

    if kind == "uniform":
        x = F.transform("d", lambda j: u("a")(j) * 255.0)
    elif kind == "rademacher":
        x = F.transform("d", lambda j: F.when(u("a")(j) < 0.5, 0.0).otherwise(255.0))
    elif kind == "gaussian":
        normal = lambda j: F.sqrt(-2 * F.ln(1 - u("a")(j))) * F.cos(2 * 3.141592653589793 * u("b")(j))
        x = F.transform("d", lambda j: F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal(j) + 0.5)) * 255.0)
    elif kind == "blobs":
        bits = ids.withColumn("b", F.transform("d", lambda j: F.when(u("a")(j) < 0.7, 1.0).otherwise(0.0)))
        # Gaussian weights of deviation 1.5 over five places either side
        weights = F.array(*[F.lit(2.718281828459045 ** (-(k * k) / 4.5)) for k in range(-5, 6)])
        near = lambda j: F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda k: F.element_at("b", (F.pmod(j + k, F.lit(dims)) + 1).cast("int")))
        smooth = lambda j: F.aggregate(F.zip_with(near(j), weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v) / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
        return bits.select("id", F.transform("d", lambda j: F.when(smooth(j) < 0.75, 0.0).otherwise(smooth(j) * 255.0)).alias("features"), F.lit(-1).alias("label"))
    else:
        raise ValueError(f"unknown noise {kind}")
    return ids.select("id", x.alias("features"), F.lit(-1).alias("label"))


def long_tail_counts(classes: int, n_max: int, factor: float, kind: str = "exp") -> list[int]:
    """Rows of each class: exp: n_max * factor^(c / (C - 1)); step: the second half of the classes gets factor * n_max."""
    if kind == "exp":
        return [int(n_max * factor ** (c / max(1, classes - 1))) for c in range(classes)]
    if kind == "step":
        return [n_max if c < classes // 2 else int(n_max * factor) for c in range(classes)]
    return [n_max] * classes


def long_tail_draws(df: DataFrame, scale: float = 1.0, seed: str = "lt", label: str = "label", order: str = "id") -> DataFrame:
    """A long tail by draws: each class keeps its rows with the class's place among sorted, normalised exponential draws."""
    draw = -F.ln(1 - unit(seed, F.col(label))) * F.lit(scale)
    classes = df.select(label).distinct().withColumn("_d", draw)
    top = classes.agg(F.max("_d")).first()[0] or 1.0
    keep = unit(seed, F.lit("row"), F.col(label), F.col(order))
    return df.join(F.broadcast(classes.select(label, (F.col("_d") / F.lit(top)).alias("_p"))), label).where(keep < F.col("_p")).select(*df.columns)


def long_tail(df: DataFrame, factor: float = 0.1, kind: str = "exp", label: str = "label", order: str = "id") -> DataFrame:
    """The first rows of each class, as many as long_tail_counts() gives it."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    counts = long_tail_counts(len(sizes), max(sizes.values(), default=0), factor, kind)
    want = df.sparkSession.createDataFrame([(k, c) for k, c in zip(sorted(sizes), counts)], T.StructType([T.StructField(label, df.schema[label].dataType), T.StructField("_n", T.IntegerType())]))
    w = Window.partitionBy(label).orderBy(order)
    return df.join(F.broadcast(want), label).withColumn("_r", F.row_number().over(w)).where("_r <= _n").select(*df.columns)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Appends experiment rows; CSV files carry a header."""
    writer = df.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def dict_literal(c: Column, schema: str = "map<string,double>") -> Column:
    """A dict written as text, with single quotes, as a map."""
    return F.from_json(F.regexp_replace(c, "'", '"'), schema)
