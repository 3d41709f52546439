"""Prompts as columns.  Wording is this project's own; `labels` adapt it to a language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: stands between pieces of a context.
SEPARATOR = "\n\n---\n\n"

ANSWER_SYSTEM = "Answer from the given context only, in as few words as possible. Name the source. If the context does not say, answer that there is not enough information."
SUMMARY_SYSTEM = "The lines are relations of a knowledge graph, written source->target->relation->description. Summarise in a few sentences what they say, with the names they mention."
CLASSIFY_SYSTEM = "Does the question ask for a single fact, or for reasoning over several? Reply with one word: fact or reasoning."
EXTRACT_SYSTEM = "Reply with JSON only."
ENTITIES_TEMPLATE = "Which names of persons, places, organisations or things does this question hold? Reply with a JSON list of texts, empty if there are none.\n\nQuestion: {query}"
EXTRACT_TEMPLATE = (
    "List the entities in the text and how they are related, {limit} relations at most. Reply with one JSON object of two lists: "
    '"entities", of objects with entity_name, entity_type and entity_description, and "relationships", of objects with source_entity, '
    "target_entity, relation and relationship_description. Both lists may be empty.\n\nText:\n{text}"
)


@dataclass(frozen=True)
class Labels:
    """Words around the parts of a prompt."""

    example: str = "Example:"
    context: str = "Context:"
    question: str = "Question:"
    answer: str = "Answer:"
    now: str = "Now answer the question:"


#: (context, question, answer)
EXAMPLES = (
    ("[source: rivers.md]\nThe Ob is 3,650 km long.", "How long is the Ob?", "According to rivers.md, 3,650 km."),
    ("[source: rivers.md]\nThe Ob is 3,650 km long.", "How deep is the Ob?", "The sources do not say; rivers.md gives its length only."),
    ("[source: a.md]\nA is north of B.\n\n[source: b.md]\nB is north of C.", "Is A north of C?", "Yes: by a.md A is north of B, and by b.md B is north of C."),
)


def simple_prompt(context: Column, question: Column, labels: Labels = Labels()) -> Column:
    return F.concat(F.lit(f"{labels.context}\n"), context, F.lit(f"\n\n{labels.question} "), question, F.lit(f"\n\n{labels.answer}"))


def few_shot_prompt(context: Column, question: Column, examples=EXAMPLES, labels: Labels = Labels()) -> Column:
    """The examples, then the query, parted by blank lines."""
    shown = [f"{labels.example}\n{labels.context}\n{c}\n\n{labels.question} {q}\n\n{labels.answer} {a}\n\n---" for c, q, a in examples]
    return F.concat_ws("\n\n", *map(F.lit, shown), F.concat(F.lit(f"{labels.now}\n"), simple_prompt(context, question, labels)))


def extraction_prompt(text: Column, limit: int = 10) -> Column:
    head, tail = EXTRACT_TEMPLATE.replace("{limit}", str(limit)).split("{text}")
    return F.concat(F.lit(head), text, F.lit(tail))


def query_entities_prompt(query: Column) -> Column:
    """For a model that names a question's entities; no retriever here needs it, as they compare vectors."""
    return F.concat(F.lit(ENTITIES_TEMPLATE.partition("{query}")[0]), query)
