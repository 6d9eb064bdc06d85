"""Text normalisers made from a configuration, as columns and as SQL functions of the session or the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import ACCENTED, ENTITIES, NOISE, PLAIN


def quoted(text: str) -> str:
    """A SQL text literal; patterns keep their backslashes."""
    return "r'" + text.replace("'", r"\x27") + "'"


@dataclass(frozen=True)
class NormalizerConfig:
    """What a normaliser does: `mode` strict (case, accents, white space), standard (words only) or aggressive (signs removed, repeats dropped)."""

    mode: str = "standard"
    remove_noise_words: bool = True
    min_word_length: int = 2
    max_word_length: int = 50
    entity_types: tuple[str, ...] = tuple(ENTITIES)

    def __post_init__(self) -> None:
        if self.mode not in ("strict", "standard", "aggressive"):
            raise ValueError(f"no mode {self.mode}")
        if unknown := set(self.entity_types) - set(ENTITIES):
            raise ValueError(f"no entity types {sorted(unknown)}")

    def folded(self, text: str) -> str:
        return f"regexp_replace(translate(lower({text}), {quoted(ACCENTED)}, {quoted(PLAIN)}), {quoted(chr(92) + 's+')}, ' ')"

    def expression(self, text: str) -> str:
        """The normalised text as a SQL expression over `text`."""
        folded = self.folded(text)
        if self.mode == "strict":
            return f"trim({folded})"
        apart = "' '" if self.mode == "standard" else "''"
        words = f"split(trim(regexp_replace(regexp_replace({folded}, {quoted('[^a-z0-9_' + chr(92) + 's]')}, {apart}), {quoted(chr(92) + 's+')}, ' ')), ' ')"
        kept = [f"length(w) >= {self.min_word_length}"]
        if self.mode == "standard":
            kept.append(f"length(w) <= {self.max_word_length}")
        if self.remove_noise_words:
            kept.append(f"w NOT IN ({', '.join(map(quoted, NOISE))})")
        words = f"filter({words}, w -> {' AND '.join(kept)})"
        return f"array_join({words if self.mode == 'standard' else f'array_distinct({words})'}, ' ')"

    def entities_expression(self, text: str) -> str:
        """A map from each entity type to its sorted distinct hits."""
        found = ", ".join(f"'{k}', array_sort(array_distinct(regexp_extract_all({self.folded(text)}, {quoted(ENTITIES[k])}, 0)))" for k in self.entity_types)
        return f"map({found})"

    def normalize(self, text: str) -> Column:
        """The same as a column expression over the column named `text`."""
        return F.expr(self.expression(f"`{text}`"))


def create_normalizer(spark: SparkSession, name: str, config: NormalizerConfig = NormalizerConfig(), persist: bool = False) -> None:
    """Make SQL functions name(text) and name_entities(text); they are expressions, so Catalyst inlines them and no Python runs.

    They last as long as the session, or with `persist` stay in its catalog. Null gives null.
    """
    kind = "FUNCTION" if persist else "TEMPORARY FUNCTION"
    spark.sql(f"CREATE OR REPLACE {kind} {name}(t STRING) RETURNS STRING RETURN {config.expression('t')}")
    spark.sql(f"CREATE OR REPLACE {kind} {name}_entities(t STRING) RETURNS MAP<STRING, ARRAY<STRING>> RETURN {config.entities_expression('t')}")
