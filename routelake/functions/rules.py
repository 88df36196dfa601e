"""Rule scores of prompts: privacy, difficulty, task type, complexity, and their fusion with predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx
from routelake.functions.text import JS_SPACE, utf16_length, word_count


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def has_word(text: Column, pattern: str) -> Column:
    """Whether the pattern stands between ASCII word boundaries."""
    return text.rlike(rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])")


def points(*scored: tuple[Column, int]) -> Column:
    return sum((F.when(condition, n).otherwise(0) for condition, n in scored), F.lit(0))


def level(score: Column, high: int, middle: int, names: list[str]) -> Column:
    return F.when(score >= high, names[2]).when(score >= middle, names[1]).otherwise(names[0])


def facts(prompt: Column) -> dict[str, Column]:
    """What the rules read of a prompt, by name: each is one pass over the text.

    ``bind`` makes columns of them, so that however many rules read one, it is found once.
    """
    text = F.lower(prompt)
    edge = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    terms = {"private_terms": lx.PRIVACY_TERMS, "coding_terms": lx.CODING_TERMS, "complex_terms": lx.COMPLEX_TERMS, "simple_terms": lx.SIMPLE_TERMS}
    terms |= {f"{name}_terms": words for name, words in lx.TASK_LEXICONS.items()}
    patterns = {
        "ssn": lx.SSN, "card": lx.CARD, "personal": lx.PERSONAL, "sensitive": lx.SENSITIVE, "depth": lx.DEPTH, "breadth": lx.BREADTH, "brevity": lx.BREVITY, "code_work": lx.CODE_WORK,
        "planning": lx.PLANNING, "coding": lx.CODING, "reasoning": lx.REASONING, "scope": lx.SCOPE, "constraint": lx.CONSTRAINT, "comparison": lx.COMPARISON, "system": lx.SYSTEM, "brief": lx.BRIEF,
        "amount": lx.AMOUNT, "advanced": "advanced", "design": "design",
    }
    return {
        "words": word_count(text),
        "length": utf16_length(prompt),
        "question": text.rlike(f"^{JS_SPACE}*(?:{lx.QUESTION}){edge[1]}"),
        "e_mail": prompt.rlike(lx.E_MAIL),
        "key": prompt.rlike(rf"(?i){edge[0]}{lx.KEY}"),
        "many_clauses": F.regexp_count(prompt, F.lit("[,;:]")) >= 3,
        "long_work": text.rlike(rf"{edge[0]}(?:{lx.LONG}){edge[1]}.{{0,24}}{edge[0]}(?:{lx.WORK}){edge[1]}"),
        **{name: contains_any(text, own) for name, own in terms.items()},
        **{name: has_word(text, pattern) for name, pattern in patterns.items()},
    }


PREFIX = "_rule_"


def bind(prompts: DataFrame, prompt: str) -> tuple[DataFrame, dict[str, Column]]:
    """``prompts`` with a column for each fact, and these columns; those that nothing reads are never computed."""
    found = facts(F.col(prompt))
    return prompts.withColumns({PREFIX + name: value for name, value in found.items()}), {name: F.col(PREFIX + name) for name in found}


def unbind(prompts: DataFrame) -> DataFrame:
    """Without the facts' columns."""
    return prompts.drop(*[c for c in prompts.columns if c.startswith(PREFIX)])


Facts = dict[str, Column]


def privacy_score(f: Facts) -> Column:
    return points((f["private_terms"], 3), (f["ssn"], 5), (f["card"], 5), (f["e_mail"], 3), (f["key"], 5), (f["personal"], 1), (f["sensitive"], 2))


def privacy_level(score: Column) -> Column:
    return level(score, 5, 2, lx.PRIVACY_LEVELS)


def difficulty_score(f: Facts) -> Column:
    size = F.when((f["words"] > 180) | (f["length"] > 1600), 4).when((f["words"] > 70) | (f["length"] > 700), 2).otherwise(0)
    return size + points((f["complex_terms"], 3), (f["depth"], 2), (f["breadth"], 2), (f["brevity"], -2), (f["coding_terms"] & f["code_work"], 1))


def difficulty_level(score: Column) -> Column:
    return level(score, 5, 2, lx.DIFFICULTIES)


def factual_question(f: Facts) -> Column:
    return (f["words"] <= 24) & f["question"] & ~f["complex_terms"]


def rule_task_type(f: Facts) -> Column:
    return (
        F.when(factual_question(f), "simple_qa")
        .when(f["translation_terms"], "translation")
        .when(f["summary_terms"], "summarization")
        .when(f["planning"], "planning")
        .when(f["coding"], "coding")
        .when(f["math_terms"], "math")
        .when(f["data_terms"], "data_analysis")
        .when(f["reasoning_terms"], "reasoning")
        .when(f["creative_terms"], "creative")
        .otherwise("unknown")
    )


def analyze_rules(f: Facts) -> dict[str, Column]:
    """The rule signals of a prompt by name."""
    factual, task = factual_question(f), rule_task_type(f)
    own, privacy = difficulty_level(difficulty_score(f)), privacy_level(privacy_score(f))
    return {
        "private": privacy == "high",
        "coding": task == "coding",
        "complex": own == "hard",
        "simple": factual | (own == "easy") | f["simple_terms"],
        "long_prompt": f["length"] > 1600,
        "factual_question": factual,
        "task_type": task,
        "difficulty": F.when(factual, "easy").otherwise(own),
        "privacy": privacy,
    }


def rank_of(label: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), label)


def stronger_privacy(rule: Column, predicted: Column) -> Column:
    """The higher of two levels; a tie keeps the rule's."""
    return F.when(rank_of(rule, lx.PRIVACY_LEVELS) >= rank_of(predicted, lx.PRIVACY_LEVELS), rule).otherwise(predicted)


def select_task_type(rule: Column, label: Column, confidence: Column, margin: Column, coverage: Column) -> Column:
    """The rule's task, or where it is unknown the predicted one if sure enough, else a simple question."""
    sure = (confidence >= 0.45) & (F.coalesce(margin, confidence) >= 0.08) & (F.coalesce(coverage, F.lit(1.0)) >= 0.15)
    return F.when(rule != "unknown", rule).when(F.coalesce(sure, F.lit(False)), label).otherwise("simple_qa")


def difficulty_evidence(label: Column, confidence: Column, margin: Column, coverage: Column) -> Column:
    weak = (confidence < 0.55) | (F.coalesce(margin, confidence) < 0.12) | (F.coalesce(coverage, F.lit(1.0)) < 0.2)
    return F.when(F.coalesce(weak, F.lit(False)), 0).when(label == "hard", 2).when(label == "medium", 1).otherwise(0)


def semantic_evidence(max_similarity: Column, strong: Column, difficulty: Column, confidence: Column) -> Column:
    base = F.when(strong >= 0.8, 3).when(strong >= 0.62, 2).when(strong >= 0.5, 1).otherwise(0)
    more = F.when((difficulty == "hard") & (confidence >= 0.6), 1).otherwise(0)
    return F.when(F.coalesce(max_similarity >= 0.45, F.lit(False)), base + more).otherwise(0)


def is_uncertain(*targets: tuple[Column, Column, Column]) -> Column:
    """Whether any target's coverage, margin or entropy tells of doubt; missing figures do not."""
    found = F.lit(False)
    for coverage, margin, entropy in targets:
        for doubt in (coverage < 0.15, margin < 0.08, entropy > 0.85):
            found = found | F.coalesce(doubt, F.lit(False))
    return found


def complexity(f: Facts, task: Column, ml: Column, semantic: Column) -> dict[str, Column]:
    """label, score and dimensions; ``ml`` and ``semantic`` are points from predictions."""
    words, length = f["words"], f["length"]
    trivial = factual_question(f) & (length <= 1600)
    size = F.when((length > 1600) | (words > 180), 4).when((length > 700) | (words > 70), 2).when(words > 35, 1).otherwise(0)
    reasoning, scope = points((f["reasoning"], 2)), points((f["scope"], 2))
    constraints = F.least(F.lit(2), points((f["constraint"], 1), (f["comparison"], 1), (f["many_clauses"], 1)))
    long_context = f["long_work"] | f["amount"]
    work = points((task.isin("coding", "math", "planning", "data_analysis", "reasoning"), 1))
    score = size + reasoning + scope + constraints + work + ml + semantic
    score = score + points((long_context, 6), (f["advanced"] & task.isin("math", "reasoning", "coding"), 2), (f["design"] & f["system"], 1))
    score = score - F.when(f["brief"] & (score < 4), 1).otherwise(0)
    none = {k: F.when(trivial, F.lit(0)).otherwise(v) for k, v in {"length": size, "reasoning": reasoning, "scope": scope, "constraints": constraints, "task": work, "ml": ml, "semantic": semantic}.items()}
    return {
        "label": F.when(trivial, "easy").otherwise(level(score, 6, 2, lx.DIFFICULTIES)),
        "score": F.when(trivial, F.lit(0)).otherwise(F.greatest(F.lit(0), score)),
        **none,
        "long_context": F.when(~trivial & long_context, F.lit(4)).otherwise(0),
    }


def routing_confidence(task: Column, privacy: Column, difficulty: Column, score: Column) -> Column:
    """Whole per cent, from confidences and the complexity score."""
    sure = F.lit(0.65) + F.least(F.lit(1.0), score / 6) * 0.25
    return F.floor((task * 0.35 + privacy * 0.35 + difficulty * 0.15 + sure * 0.15) * 100 + 0.5).cast("int")


def signal_text(source: Column, task: Column, difficulty: Column, privacy: Column, confidence: Column) -> Column:
    told = F.format_string("ML predicted %s/%s/%s privacy with %d%% confidence.", task, difficulty, privacy, confidence)
    return F.when(source == "ml", told).otherwise("Rule fallback analyzed the prompt.")
