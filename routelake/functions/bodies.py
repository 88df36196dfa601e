"""Bodies of chat requests and provider replies as columns.  A body that is no JSON fails no job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelake.functions.text import JS_SPACE, bound, chat_role

#: Names that a provider's messages carry.
PROVIDERS = {"groq": "Groq", "google": "Google AI Studio"}
TEMPERATURE = 0.7


def _at(body: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(body, path, kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def _truthy(value: Column) -> Column:
    """Whether a VARIANT counts as true in JavaScript: not null, false, zero or an empty string."""
    kind = _kind(value)
    told = F.when(kind == "STRING", _at(value, "$", "string") != "").when(kind == "BOOLEAN", _at(value, "$", "boolean"))
    return told.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True).when(kind == "VOID", False).otherwise(_at(value, "$", "double") != 0)


def request_body(text: Column) -> Column:
    """The body of a request as VARIANT: an empty one (or null) is an empty object, one that is no JSON is null."""
    return F.try_parse_json(F.when(F.coalesce(text, F.lit("")) == "", "{}").otherwise(text))


def reply_body(text: Column) -> Column:
    """The body of a reply as VARIANT: as a request's, but plain text is the message of an error."""
    plain = F.to_json(F.struct(F.struct(text.alias("message")).alias("error")))
    return F.coalesce(request_body(text), F.parse_json(plain))


def request_messages(body: Column, keep: int = 20) -> Column:
    """The last messages of a request's list, as (role, content): trimmed, none blank, in two roles.

    Items without a text as content are left out; null where ``messages`` is no list.
    """
    listed = F.when(_kind(_at(body, "$.messages")).startswith("ARRAY"), _at(body, "$.messages", "array<variant>"))
    told = F.filter(listed, lambda m: _kind(_at(m, "$.content")) == "STRING")
    role = lambda m: chat_role(F.coalesce(_at(m, "$.role", "string"), F.lit("")))
    clean = F.transform(told, lambda m: F.struct(role(m).alias("role"), _trim(_at(m, "$.content", "string")).alias("content")))
    filled = F.filter(clean, lambda m: m["content"] != "")
    return bound(filled, lambda own: F.slice(own, F.greatest(F.size(own) - keep + 1, F.lit(1)), F.lit(keep)))


def provider_request(provider: Column, model: Column, messages: Column) -> Column:
    """The JSON that a provider is asked with, for messages (role, content); null for other providers."""
    part = lambda m: F.struct(chat_role(m["role"], "google").alias("role"), F.array(F.struct(m["content"].alias("text"))).alias("parts"))
    google = F.struct(F.transform(messages, part).alias("contents"), F.struct(F.lit(TEMPERATURE).alias("temperature")).alias("generationConfig"))
    other = F.struct(model.alias("model"), messages.alias("messages"), F.lit(TEMPERATURE).alias("temperature"))
    known = F.when(provider == "google", F.to_json(google)).when(provider == "groq", F.to_json(other))
    return F.when(messages.isNotNull(), known)


def reply_error(body: Column, fallback: Column) -> Column:
    """What a failed reply says: ``error.message``, else ``error`` if it is a text, else its JSON (keys sorted), else the fallback."""
    error, message = _at(body, "$.error"), _at(body, "$.error.message")
    said = F.when(_truthy(message), message).otherwise(error)
    return F.when(_kind(said) == "STRING", _at(said, "$", "string")).when(_truthy(said), F.to_json(said)).otherwise(fallback)


def reply_content(provider: Column, body: Column) -> Column:
    """The text of a reply; null if there is none or it is empty.  One provider sends it in parts, and these are joined and trimmed."""
    parts = _at(body, "$.candidates[0].content.parts", "array<variant>")
    joined = _trim(F.array_join(F.transform(parts, lambda p: F.coalesce(_at(p, "$.text", "string"), F.lit(""))), ""))
    text = F.when(provider == "google", joined).otherwise(_at(body, "$.choices[0].message.content", "string"))
    return F.when(text != "", text)


def reply_usage(provider: Column, body: Column) -> Column:
    """input_tokens, output_tokens and total_tokens of a reply; what is not told is 0."""
    count = lambda *paths: sum((F.coalesce(_at(body, p, "long"), F.lit(0)) for p in paths[1:]), F.coalesce(_at(body, paths[0], "long"), F.lit(0)))
    google = F.struct(
        count("$.usageMetadata.promptTokenCount").alias("input_tokens"),
        count("$.usageMetadata.candidatesTokenCount", "$.usageMetadata.thoughtsTokenCount").alias("output_tokens"),
        count("$.usageMetadata.totalTokenCount").alias("total_tokens"),
    )
    other = F.struct(*[count(f"$.usage.{theirs}").alias(ours) for theirs, ours in (("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"), ("total_tokens", "total_tokens"))])
    return F.when(provider == "google", google).otherwise(other)


def reply(provider: Column, status: Column, text: Column) -> Column:
    """content, error and the three token counts of a reply with an HTTP status; either content or error is null.

    Outside of 200 to 299 the error is the provider's own; a reply without text is an error as well.
    Token counts are null where there is no content.
    """

    def told(own: Column) -> Column:
        body, provider = own["body"], own["provider"]
        name = F.coalesce(*[F.when(provider == key, value) for key, value in PROVIDERS.items()], provider)
        failed = F.when(own["ok"], F.concat(name, F.lit(" returned an empty response."))).otherwise(reply_error(body, F.concat(name, F.lit(" request failed."))))
        return bound(F.when(own["ok"], reply_content(provider, body)), lambda content: whole(provider, body, content, failed))

    def whole(provider: Column, body: Column, content: Column, failed: Column) -> Column:
        usage = reply_usage(provider, body)
        counts = [F.when(content.isNotNull(), usage[k]).alias(k) for k in ("input_tokens", "output_tokens", "total_tokens")]
        return F.struct(content.alias("content"), F.when(content.isNull(), failed).alias("error"), *counts)

    ok = F.coalesce(status.between(200, 299), F.lit(False))
    return bound(text, lambda t: bound(F.struct(reply_body(t).alias("body"), provider.alias("provider"), ok.alias("ok")), told))
