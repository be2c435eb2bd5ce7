"""Parsing responses and building prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reward import canonical_tool
from ..tools import function_schema

BLOCK = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
ANY_BLOCK = r"(?s)<tool_call>.*?</tool_call>"
CALL = "struct<name:string,arguments:struct<bbox_2d:array<double>,bbox:array<double>,label:string,angle:double>>"
MEDIA = r"<image>|<video>"


def call_objects(text: Column) -> Column:
    """Parsed call objects in order; unreadable ones are dropped. Single-quoted text gets a second try with double quotes;
    text is never evaluated."""
    raw = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    first = lambda s: F.from_json(s, CALL, {"mode": "PERMISSIVE"})
    parsed = F.transform(raw, lambda s: F.coalesce(F.when(first(s)["name"].isNotNull(), first(s)), first(F.replace(s, F.lit("'"), F.lit('"')))))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def parse_tool_calls(text: Column) -> Column:
    """array of struct(raw_name, tool_name, bbox, label, output): names lower-cased and canonical (unknown ones kept).
    Outputs are attached as coded: the text after the k-th block goes to the k-th parsed call, and whatever follows the
    last parsed call's block overwrites that call's output, so an unreadable block shifts them."""
    calls, texts = call_objects(text), outputs(text)
    output = lambda i: F.when(i == F.size(calls) - 1, F.get(texts, F.size(texts) - 1)).otherwise(F.get(texts, i))
    low = lambda c: F.lower(c["name"])
    return F.transform(calls, lambda c, i: F.struct(c["name"].alias("raw_name"), F.coalesce(canonical_tool(low(c)), low(c)).alias("tool_name"), F.coalesce(c["arguments"]["bbox_2d"], c["arguments"]["bbox"]).alias("bbox"), c["arguments"]["label"].alias("label"), output(i).alias("output")))


def outputs(text: Column) -> Column:
    """Trimmed text after each block, up to the next."""
    return F.transform(F.slice(F.split(text, ANY_BLOCK), F.lit(2), F.size(F.split(text, ANY_BLOCK))), lambda x: F.trim(x))


def parse_first_call(text: Column) -> Column:
    """The first block's object, else the first json fence's."""
    first = lambda pattern: F.from_json(F.regexp_extract(text, pattern, 1), CALL)
    block = first(BLOCK)
    return F.when(block["name"].isNotNull(), block).otherwise(first(r"(?s)```json\s*(\{.*?\})\s*```"))


def boxed_answer(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)<answer>\n\\boxed\{(.*?)\}\n</answer>", 1)


def normalize_args(args: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """A map of arguments with aliased keys renamed and unknown ones dropped."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.map_filter(F.transform_keys(args, lambda k, _: F.coalesce(names[k], k)), lambda k, _: k.isin(known))


def split_media(text: Column) -> Column:
    """Typed parts in order: text between <image> and <video> marks (empty text kept) and the marks."""
    pieces = F.split(text, rf"(?=(?:{MEDIA}))|(?<=(?:{MEDIA}))")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def split_media_clues(text: Column) -> Column:
    """As split_media, each image between clue marks; a video mark stays text."""
    part = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    null = F.lit(None).cast("string")
    clue = F.array(part("text", F.lit("<image_clue_0>")), part("image", null), part("text", F.lit("</image_clue_0>")))
    return F.flatten(F.transform(split_media(text), lambda p: F.when(p["type"] == "image", clue).when(p["type"] == "video", F.array(part("text", F.lit("<video>")))).otherwise(F.array(part("text", p["text"])))))


def user_prompt(question: Column, options: Column, instruction: str) -> Column:
    lettered = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\n" + instruction))


# fixed values: the texts of a system prompt around the tools' schemas, and the two answer policies
PROMPT_HEAD = """You are a helpful assistant.

# Tools
You may call one or more functions to assist with the user query.
You are provided with function signatures within <tools></tools> XML tags:
<tools>
"""
PROMPT_CALLS = """
</tools>

# How to call a tool
Return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>

# Coordinate system (IMPORTANT)
All bbox_2d values MUST be NORMALIZED coordinates: each value is a fraction
of the image size in [0, 1], where (0,0) = top-left corner and (1,1) = bottom-right
corner of the image you are currently viewing. Do NOT use pixel values.
Your coordinates are scaled automatically by the tool executor.

# Answer policy (IMPORTANT)
"""
PROMPT_POLICIES = {
    "answer_first": """1. FIRST, answer directly from the full image: <answer>your answer</answer>
2. ONLY if you cannot determine the answer from the full image
   (object too small, text unreadable, details unclear) may you call a tool
   to inspect. Call ONE tool per turn, inspect the returned image, then answer.
""",
    "tool_first": """1. BEFORE answering, you MUST call a tool to verify the target object:
   zoom into the relevant region (or crop it) and inspect the returned image.
2. Call ONE tool per turn; you may call several tools in sequence.
""",
}
PROMPT_TAIL = """3. After inspecting tool results, give your final answer in <answer> tags.

Tools available:
<tool_call>
{"name": "zoom", "arguments": {"bbox_2d": [0.15, 0.25, 0.28, 0.38]}}
</tool_call>
Use ocr to read text, rotate only if the image orientation is wrong.

When you have enough evidence, provide your answer inside <answer> tags:
<answer>your answer</answer>"""


def system_prompt(tools: list[str], mode: Column, specs: dict | None = None) -> Column:
    """The prompt of a row's mode (answer_first or tool_first; null for any other) with the schemas of `tools` in their order.

    `specs` describes tools as `tools.SPECS` does; a tool that it lacks is an error when the column is built.
    """
    schemas = "\n".join(function_schema(t, specs) for t in tools)
    text = {k: PROMPT_HEAD + schemas + PROMPT_CALLS + policy + PROMPT_TAIL for k, policy in PROMPT_POLICIES.items()}
    return F.create_map(*[F.lit(x) for kv in text.items() for x in kv])[mode]


def build_question(problem: Column, options: Column, guideline: str, templates: dict[str, str], kind: Column) -> Column:
    text = F.concat_ws("\n", problem, F.array_join(options, "\n"))
    by_kind = F.coalesce(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])[kind], F.lit(""))
    return F.concat(text, F.lit("\n" + guideline), by_kind)


def rebuild_call_text(name: Column, box: Column, w: Column, h: Column) -> Column:
    """A call as block text with its pixel box normalised to 6 places."""
    sides = F.transform(F.arrays_zip(box.alias("b"), F.array(w, h, w, h).alias("s")), lambda p: F.round(p["b"] / p["s"], 6))
    return F.concat(F.lit("<tool_call>"), F.to_json(F.struct(name.alias("name"), F.struct(sides.alias("bbox_2d")).alias("arguments"))), F.lit("</tool_call>"))


def media_token_check(text: Column, images: Column) -> Column:
    return F.regexp_count(text, F.lit("<image>")) == F.size(images)


def tag_balance(text: Column, most: int = 1000) -> Column:
    """Whether think, answer and tool tags are balanced, the answer holds no mark, and the answer is shorter than most."""
    same = lambda t: F.regexp_count(text, F.lit(f"<{t}>")) == F.regexp_count(text, F.lit(f"</{t}>"))
    answer = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    return same("think") & same("answer") & same("tool_call") & ~answer.rlike("<(think|answer|tool_call)>") & (F.length(answer) < most)


def strip_system_block(text: Column) -> Column:
    """Without the first system block."""
    pattern = r"(?s)^(.*?)<system>.*?</system>(.*)$"
    return F.regexp_replace(text, pattern, "$1$2")


def wikihow_clean(text: Column) -> Column:
    s = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(s, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def parse_responses(df: DataFrame, text: str = "response") -> DataFrame:
    """df with calls, answer and n_unparsed (blocks that gave no call)."""
    return df.withColumns({"calls": parse_tool_calls(F.col(text)), "n_unparsed": F.regexp_count(F.col(text), F.lit(ANY_BLOCK)) - F.size(call_objects(F.col(text)))})
