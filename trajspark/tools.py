"""The tool dimension: one row a tool, small enough to broadcast."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, aliases array<string>, spatial boolean, updates_state boolean, params array<string>"
# fixed values: the registered tools
TOOLS = [
    ("crop", ["crop_image", "crop_image_normalized"], True, False, ["bbox_2d", "bbox"]),
    ("zoom", ["zoom_in"], True, True, ["bbox_2d", "bbox"]),
    ("rotate", [], False, True, ["angle"]),
    ("ocr", [], False, False, ["bbox_2d", "bbox"]),
]

# fixed values: what a prompt says of each tool and its parameter; the last field tells whether the parameter is required
SPECS = {
    "crop": ("Crop a region of the image to examine details.", "bbox_2d", "The region as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left corner of the image, 1,1 = bottom-right.", True),
    "zoom": ("Zoom into a region to see fine details.", "bbox_2d", "The region to zoom into as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left, 1,1 = bottom-right.", True),
    "rotate": ("Rotate the image by a specified angle.", "angle", "Rotation angle in degrees (e.g., 90, 180, 270). Positive values rotate counter-clockwise.", True),
    "ocr": ("Extract text from a region of the image.", "bbox_2d", "The region to read as NORMALIZED [x1, y1, x2, y2]: each value in [0,1], 0,0 = top-left, 1,1 = bottom-right. Omit to OCR the whole image.", False),
}
KINDS = {"bbox_2d": {"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4}, "angle": {"type": "integer"}}


def function_schema(name: str, specs: dict | None = None) -> str:
    """A tool's function schema as one line of JSON."""
    description, parameter, meaning, required = (specs or SPECS)[name]
    properties = {parameter: {**KINDS[parameter], "description": meaning}}
    parameters = {"type": "object", "properties": properties, "required": [parameter] if required else []}
    return json.dumps({"type": "function", "function": {"name": name, "description": description, "parameters": parameters}})


def tool_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, SCHEMA)


def register(tools: DataFrame, name: str, aliases: list[str], spatial: bool = False, updates_state: bool = False, params: list[str] | None = None) -> DataFrame:
    """tools with one more; a name or alias that is taken is an error."""
    taken = tools.where(F.col("name").isin(name, *aliases) | F.arrays_overlap("aliases", F.array(*map(F.lit, [name, *aliases]))))
    if not taken.isEmpty():
        raise ValueError(f"tool {name} or one of its aliases is registered already")
    return tools.unionByName(tools.sparkSession.createDataFrame([(name, aliases, spatial, updates_state, params or [])], SCHEMA))
