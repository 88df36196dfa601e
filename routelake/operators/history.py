"""Conversations, feedback and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.text import JS_SPACE, chat_role
from routelake.operators.ranges import placed
from routelake.operators.relational import small, tail


def normalized_messages(messages: DataFrame, conversation: str, order: str, role: str, text: str, keep: int = 20, provider: str = "groq") -> DataFrame:
    """The last messages of each conversation that are not blank, in two roles, numbered from 1 in order."""
    filled = messages.where(F.regexp_replace(F.coalesce(text, F.lit("")), f"{JS_SPACE}+", "") != "")
    last = tail(filled, [conversation], order, keep)
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(order))
    return last.withColumn(role, chat_role(F.col(role), provider)).withColumn("position", place)


def first_user_turn(messages: DataFrame, conversation: str, order: str, role: str, sanitized: str) -> DataFrame:
    """conversation, prompt: the first user turn with text left after sanitising; an empty prompt if there is none."""
    own = F.lower(F.coalesce(role, F.lit(""))).isin("user", "human", "") & (F.col(sanitized) != "")
    return messages.groupBy(conversation).agg(F.coalesce(F.min_by(F.when(own, F.col(sanitized)), F.when(own, F.col(order))), F.lit("")).alias("prompt"))


def fold_feedback(clicks: DataFrame, key: str, order: str) -> DataFrame:
    """key, rating, expected after a fold of clicks (kind, selected, choice) in order.

    Repeating a rating clears it; positive expects the selected model, negative none; a
    correction counts only while the rating is negative.  A key's clicks are one message's.
    """
    sorted_ = clicks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "kind", "selected", "choice"))).alias("_c"))
    none = "cast(null as string)"
    state = F.expr(
        f"""aggregate(_c, named_struct('rating', {none}, 'expected', {none}), (s, x) -> case
        when x.kind = 'correct' then if(s.rating <=> 'negative', named_struct('rating', s.rating, 'expected', x.choice), s)
        when s.rating <=> x.kind then named_struct('rating', {none}, 'expected', {none})
        when x.kind = 'positive' then named_struct('rating', x.kind, 'expected', x.selected)
        else named_struct('rating', x.kind, 'expected', {none}) end)"""
    )
    return sorted_.select(key, state.alias("_s")).select(key, "_s.rating", "_s.expected")


def usable_feedback(rating: Column, expected: Column) -> Column:
    return F.coalesce((rating == "positive") | ((rating == "negative") & (F.coalesce(expected, F.lit("")) != "")), F.lit(False))


def training_examples(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions with usable feedback, the expected model's name (or id) and whether it differs from the selected one.

    A positive rating expects the selected model, whatever is stored beside it.
    """
    names = small(catalog.select(F.col("id").alias("_id"), F.col("name").alias("_name")))
    usable = decisions.where(usable_feedback(F.col("rating"), F.col("expected"))).withColumn("expected", F.when(F.col("rating") == "positive", F.col("selected")).otherwise(F.col("expected")))
    named = usable.join(names, F.col("expected") == F.col("_id"), "left")
    return named.withColumn("expected_name", F.coalesce("_name", "expected")).withColumn("corrected", F.col("expected") != F.col("selected")).drop("_id", "_name")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with total tokens and estimated cost in dollars; models without a price cost nothing."""
    own = small(prices.select(F.col("model").alias("_m"), "input_usd", "output_usd"))
    priced = usage.join(own, F.col("model") == F.col("_m"), "left")
    zero = F.lit(0.0)
    cost = F.col("input_tokens") * F.coalesce("input_usd", zero) / 1e6 + F.col("output_tokens") * F.coalesce("output_usd", zero) / 1e6
    return priced.withColumn("total_tokens", F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))).withColumn("cost_usd", cost).drop("_m", "input_usd", "output_usd")


def provider_usage(provider: Column, raw: Column) -> tuple[Column, Column]:
    """Input and output tokens from a provider's own JSON."""
    get = lambda path: F.coalesce(F.get_json_object(raw, path).cast("long"), F.lit(0))
    google = get("$.promptTokenCount"), get("$.candidatesTokenCount") + get("$.thoughtsTokenCount")
    local = get("$.prompt_eval_count"), get("$.eval_count")
    other = get("$.prompt_tokens"), get("$.completion_tokens")
    return tuple(F.when(provider == "google", g).when(provider == "ollama", o).otherwise(x) for g, o, x in zip(google, local, other, strict=True))


MESSAGE = "struct<id:string,role:string,content:string>"


def saved_conversations(saved: DataFrame, json: str) -> DataFrame:
    """id, title, updated_at, messages of the conversations in saved documents: objects whose ``conversations`` is a list.

    Only entries with a string as id and a list of messages pass; damaged documents give none.
    """
    kind = lambda v, path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    each = saved.select(F.explode(F.try_variant_get(F.try_parse_json(json), "$.conversations", "array<variant>")).alias("_v"))
    valid = each.where((kind(F.col("_v"), "$.id") == "STRING") & kind(F.col("_v"), "$.messages").startswith("ARRAY"))
    get = lambda name, type_: F.try_variant_get("_v", f"$.{name}", type_)
    return valid.select(get("id", "string").alias("id"), get("title", "string").alias("title"), get("updatedAt", "string").alias("updated_at"), get("messages", f"array<{MESSAGE}>").alias("messages"))


def stored_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations (id, messages and more) as loaded: those without an id or messages dropped, message ids that
    are missing filled from the conversation's id and the position, reasoning tags stripped from the assistant's."""
    from routelake.functions.text import strip_think

    fields = conversations.schema["messages"].dataType.elementType.names
    known = (lambda m: m["id"]) if "id" in fields else (lambda m: F.lit(None).cast("string"))
    made = lambda i: F.concat(F.lit("message-"), F.substring(F.sha2(F.encode(F.concat_ws("/", F.col("id"), i.cast("string")), "utf-8"), 256), 1, 32))
    content = lambda m: F.when(m["role"] == "assistant", strip_think(m["content"], client=True)).otherwise(m["content"])
    shown = F.transform("messages", lambda m, i: m.withField("id", F.coalesce(known(m), made(i))).withField("content", content(m)))
    return conversations.where(F.col("id").isNotNull() & F.col("messages").isNotNull()).withColumn("messages", shown)


def history_order(conversations: DataFrame) -> DataFrame:
    """Conversations with their place, from 1, the last changed first; of equal ones the smaller id."""
    return placed(conversations, [], [F.desc("updated_at"), "id"], "place")


def route_decisions(conversations: DataFrame) -> DataFrame:
    """A row for each message that carries a route decision, with the feedback beside it."""
    each = conversations.select(F.col("id").alias("conversation"), F.posexplode("messages").alias("position", "m"))
    return each.where("m.route_decision is not null").select("conversation", "position", "m.route_decision.*", "m.feedback.*")


def usable_examples(examples: DataFrame) -> DataFrame:
    """Routing examples that have a text and a route class."""
    return examples.where("text is not null and route_class is not null")


def export_feedback(examples: DataFrame, decisions: DataFrame, path: str, exported_at: str) -> dict:
    """Write training examples and route decisions as JSON lines below ``path``, and a document that describes both; returns it."""
    from routelake.sources.files import write_document, write_jsonl

    told = {"schema_version": 1, "exported_at": exported_at}
    told |= {name: write_jsonl(rows, f"{path}/{name}") for name, rows in (("training_examples", examples), ("route_decisions", decisions))}
    write_document(examples.sparkSession, told, f"{path}/export")
    return told


def feedback_document(examples: DataFrame, decisions: DataFrame, exported_at: str, path: str, order: tuple[list[str], list[str]]) -> None:
    """The export as one JSON document in parts below ``path``, each list in the order of the columns named."""
    from routelake.sources.files import write_parts

    head = {"schema_version": 1, "exported_at": exported_at}
    write_parts(examples.sparkSession, head, {"training_examples": (examples, order[0]), "route_decisions": (decisions, order[1])}, path)
