"""Plug-in recognisers: images in, text boxes out. No model comes with this package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.layout import BOX
from ..runtime import ship
from .kb import KnowledgeBase

# What an image has to be like.
MOST_BYTES, MOST_FILES, LEAST_SIDE, SMALL_SIDE, TARGET_SIDE, MOST_SIDE = 12 << 20, 20, 200, 400, 1400, 2600


class RecognizerMissing(RuntimeError):
    """No recogniser is registered; an error is never turned into an empty result."""


@dataclass
class Recognizer:
    name: str
    detect: Callable[[bytes], list[dict]]
    load: Callable[[], None] | None = None


_registered: dict[str, Recognizer] = {}


def register(recognizer: Recognizer) -> None:
    _registered[recognizer.name] = recognizer


def recognizer(name: str | None = None) -> Recognizer:
    if not _registered or (name and name not in _registered):
        raise RecognizerMissing(name or "none registered")
    return _registered[name] if name else next(iter(_registered.values()))


def images(spark: SparkSession, folder: str, most: int | None = MOST_FILES) -> DataFrame:
    """Image files of a folder: by suffix and size, one for each name and size, the first `most` of them as the upload form takes (None: all)."""
    found = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(png|jpe?g|webp|bmp|gif)$") & (F.col("length") <= MOST_BYTES))
    one = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).dropDuplicates(["name", "length"])
    return one.orderBy("modificationTime", "path").limit(most) if most else one


def size_policy(width, height):
    """struct(action, scale): too small, scaled up, scaled down or as it is."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    scale = F.when(short < SMALL_SIDE, F.least(F.lit(TARGET_SIDE) / short, F.lit(MOST_SIDE) / long_)).when(long_ > MOST_SIDE, F.lit(MOST_SIDE) / long_).otherwise(F.lit(1.0))
    return F.struct(F.when(short < LEAST_SIDE, "reject").when(short < SMALL_SIDE, "up").when(long_ > MOST_SIDE, "down").otherwise("keep").alias("action"), scale.alias("scale"))


_loaded: dict[str, Recognizer] = {}


def loaded(plug_in: Recognizer) -> Recognizer:
    """A plug-in ready for use in this Python worker: loaded once, whatever tasks run in it, and again after a failure."""
    if plug_in.name not in _loaded:
        if plug_in.load:
            plug_in.load()
        _loaded[plug_in.name] = plug_in
    return _loaded[plug_in.name]


class _Recognise:
    """The table function's handler: an image's path and content -> one row."""

    plug_in: Recognizer

    def eval(self, path: str, content: bytes):
        try:
            yield path, loaded(self.plug_in).detect(bytes(content)), None
        except Exception as e:  # noqa: BLE001  kept for the row
            _loaded.pop(self.plug_in.name, None)
            yield path, None, f"{type(e).__name__}: {e}"


def table_function(plug_in: Recognizer | None = None):
    """A Python table function (path, content) -> (image_id, boxes, error) of a plug-in, for lateral joins and, once registered, for SQL."""
    handler = type("Recognise", (_Recognise,), {"plug_in": plug_in or recognizer()})
    return F.udtf(handler, returnType=f"image_id string, boxes array<{BOX}>, error string")


def recognised(images_: DataFrame, plug_in: Recognizer | None = None) -> DataFrame:
    """(path, content) -> image_id, boxes, error: a failing image keeps its own error and does not stop the others; the plug-in is loaded anew after it.

    A null content is an image that fails. Images go to the workers some at a time; none has more than MOST_BYTES.
    """
    ship(images_.sparkSession)
    function = table_function(plug_in)
    return images_.select("path", "content").lateralJoin(function(F.col("path").outer(), F.col("content").outer())).select("image_id", "boxes", "error")


def label_sources(images_: DataFrame, kb: KnowledgeBase, plug_in: Recognizer | None = None) -> DataFrame:
    """Images to label sources: recognised boxes laid out as lines, regions and texts; what failed has no boxes and so no texts."""
    return layout.label_sources(recognised(images_, plug_in), "boxes", kb)
