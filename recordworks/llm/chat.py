r"""Chat formatting: turns of typed content parts become one marked string each, with placeholders, attachments and a loss mask.

A turn's content is a list of parts: text, image, audio or document.  A visitor has one method for each type; it turns a part into what is
written for it, and for an attachment also into its reference and the number of tokens that its placeholder expands to.  `flattened` visits
the parts in order: the i-th placeholder of a turn belongs to the i-th attachment recorded for it.  Plain texts become parts first
(`parts_of`): Markdown images and links to audio or document files are attachments, what stands between them is text.

A turn is written as `<s>` role `[INST]` content `</s>`.  Control strings inside texts and roles are broken up by a backslash behind their first
character, and backslashes are doubled, so the output holds a control string only where the template put it and every text can be read back.  The
loss mask of a turn is a span of code points of its string: the content of the roles that are learned.  `read_back` parses
the strings again, through the mask for the learned texts.

Everything up to here is column expressions, row by row.  A conversation is the sequence of its turns and is never put together in memory:
digests of whole conversations stream over rows sorted by turn, one running hash at a time, so a conversation of any number of turns needs
constant memory.  As such a hash is sequential, one task reads the turns of one conversation.

Defined results: null text is the empty text, a null role the empty role, null parts or a part of null or unknown type count as a text part (null text: empty); a null
conversation id is a conversation of its own.  Turns are ordered by number (null first), ties by role and text; repeated rows are repeated turns.
Very long texts are formatted as a whole.  An attachment without measures expands to the least number of tokens of its type.  An empty table
gives an empty result.  Other columns aren't read, so no name of theirs can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import small_batches

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,source:string>"
_MEASURES = ("ref", "width", "height", "seconds", "pages", "source")
#: what Markdown can attach: ![...](...) and [...](name.ext) of the types below
REFERENCE = r"(?:!\[[^\]\n]*\]\([^()\s]+\)|\[[^\]\n]*\]\([^()\s]+\.(?:mp3|wav|ogg|flac|pdf|docx?|odt)\))"


@dataclass(frozen=True)
class Template:
    """The markers of a turn, the placeholders, and the other strings that a tokenizer might take for control strings."""

    begin: str = "<s>"
    content: str = "[INST]"
    end: str = "</s>"
    placeholders: tuple[tuple[str, str], ...] = (("image", "<|image|>"), ("audio", "<|audio|>"), ("document", "<|document|>"))
    others: tuple[str, ...] = ("[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    learned: tuple[str, ...] = ("assistant",)

    @property
    def control(self) -> list[str]:
        return [self.begin, self.content, self.end, *dict(self.placeholders).values(), *self.others]

    def escaped(self, text: Column) -> Column:
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.control)
        return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), starts, r"$0\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    @property
    def any_placeholder(self) -> str:
        return "|".join(re.escape(p) for p in dict(self.placeholders).values())


class PartVisitor:
    """What each type of part becomes: (written, kind, ref, tokens, source); kind is null for text."""

    def __init__(self, template: Template, patch: int = 14, tokens_a_second: float = 25.0, tokens_a_page: int = 512):
        self.template, self.patch, self.rate, self.page = template, patch, tokens_a_second, tokens_a_page

    def visit(self, part: Column) -> Column:
        kinds = {"image": self.image, "audio": self.audio, "document": self.document}
        out = None
        for kind, method in kinds.items():
            test = part["type"] == kind
            out = F.when(test, method(part)) if out is None else out.when(test, method(part))
        return out.otherwise(self.text(part))

    def text(self, part: Column) -> Column:
        return self._result(self.template.escaped(F.coalesce(part["text"], F.lit(""))), None, part, F.lit(0))

    def image(self, part: Column) -> Column:
        patches = F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)
        return self._attachment("image", part, patches)

    def audio(self, part: Column) -> Column:
        return self._attachment("audio", part, F.ceil(part["seconds"] * self.rate))

    def document(self, part: Column) -> Column:
        return self._attachment("document", part, part["pages"] * self.page)

    def _attachment(self, kind: str, part: Column, tokens: Column) -> Column:
        return self._result(F.lit(dict(self.template.placeholders)[kind]), kind, part, F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)))

    @staticmethod
    def _result(written: Column, kind: str | None, part: Column, tokens: Column) -> Column:
        return F.struct(written.alias("written"), F.lit(kind).cast("string").alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"), part["source"].alias("source"))


def parts_of(text: Column) -> Column:
    """The parts of a plain text.  An attachment keeps the characters that it stood for as `source`."""
    text = F.coalesce(text, F.lit(""))
    null = {c: F.lit(None).alias(c) for c in _MEASURES}
    words = F.transform(F.split(text, REFERENCE, -1), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), *null.values()).cast(PART))

    def attachment(source: Column) -> Column:
        ref = F.regexp_extract(source, r"\(([^()]*)\)$", 1)
        kind = F.when(source.startswith("!"), "image").when(F.lower(ref).rlike(r"\.(mp3|wav|ogg|flac)$"), "audio").otherwise("document")
        return F.struct(kind.alias("type"), F.lit(None).alias("text"), ref.alias("ref"), *[null[c] for c in _MEASURES[1:-1]], source.alias("source")).cast(PART)

    others = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), attachment)
    mixed = F.flatten(F.transform(F.arrays_zip(words.alias("w"), others.alias("o")), lambda x: F.array(x["w"], x["o"])))
    return F.filter(mixed, lambda p: p.isNotNull())


def flattened(parts: Column, visitor: PartVisitor) -> Column:
    """(content, attachments) of the visited parts; an attachment is (kind, ref, tokens, source)."""
    whole = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    visited = F.transform(whole, visitor.visit)
    kept = F.transform(F.filter(visited, lambda v: v["kind"].isNotNull()), lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens"), v["source"].alias("source")))
    return F.struct(F.array_join(F.transform(visited, lambda v: v["written"]), "").alias("content"), kept.alias("attachments"))


def formatted(turns: DataFrame, template: Template = Template(), visitor: PartVisitor | None = None,
              conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, formatted, loss_start, loss_end (code points of `formatted`, end exclusive; null without loss),
    attachments and expanded_tokens.  Content comes from `parts` if given, else from the plain `text`."""
    visitor = visitor or PartVisitor(template)
    content = F.col(parts).cast(f"array<{PART}>") if parts else parts_of(F.col(text))
    name = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(template.begin), template.escaped(name), F.lit(template.content))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), name.isin(*template.learned).alias("learned"), head.alias("head"), flattened(content, visitor).alias("f"))
    end = F.lit(len(template.end))
    rows = rows.select("conv_id", "turn", "learned", F.length("head").alias("at"), F.concat("head", "f.content", F.lit(template.end)).alias("formatted"), "f.attachments")
    return rows.select("conv_id", "turn", "formatted", F.when(F.col("learned"), F.col("at")).alias("loss_start"),
                       F.when(F.col("learned"), F.length("formatted") - end).alias("loss_end"), "attachments",
                       F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_back(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """The output of `formatted` with role, text and loss_text (null without loss) parsed from it.  Placeholders become what they stood for in a plain
    text; those of given parts become nothing."""
    whole = F.col("formatted")
    split_at = F.locate(template.content, "formatted")
    body = F.substring(whole, split_at + len(template.content), F.length(whole) - split_at - len(template.content) + 1 - len(template.end))
    masked = F.substring(whole, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    sources = F.concat(F.transform("attachments", lambda a: F.coalesce(a["source"], F.lit(""))), F.array(F.lit("")))

    def plain(content: Column) -> Column:
        texts = F.transform(F.split(content, template.any_placeholder, -1), template.unescaped)
        return F.array_join(F.zip_with(texts, sources, lambda t, s: F.concat(F.coalesce(t, F.lit("")), F.coalesce(s, F.lit("")))), "")

    role = template.unescaped(F.substring(whole, F.lit(len(template.begin) + 1), split_at - 1 - len(template.begin)))
    return rows.select("*", role.alias("role"), plain(body).alias("text"), F.when(F.col("loss_start").isNotNull(), plain(masked)).alias("loss_text"))


def digests(turns: DataFrame) -> DataFrame:
    """The output of `read_back` -> one row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    expanded_tokens.  A learned text that equals the turn's text is not sent twice."""
    small_batches(turns.sparkSession, rows=2000)
    same = F.col("loss_text") == F.col("text")
    sent = turns.select("conv_id", "turn", "role", "text", same.alias("same"), F.when(~same, F.col("loss_text")).alias("loss"), F.length("formatted").alias("chars"),
                        F.size("attachments").alias("attached"), "expanded_tokens")
    ordered = sent.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None  # the running conversation: id, counts and hashes

        def row() -> tuple:
            conv, counts, turns_hash, loss_hash = own
            return conv, counts[0], turns_hash.hexdigest(), counts[1], loss_hash.hexdigest(), *counts[2:]

        def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=NAMES)

        kind = pa.int64()
        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            for conv, role, text, same, loss, chars, attached, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "same", "loss", "chars", "attached", "expanded_tokens"))):
                if own is None or own[0] != conv:
                    done += [row()] if own else []
                    own = conv, [0, 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                _, counts, turns_hash, loss_hash = own
                turns_hash.update(f"{role}\n{text}\n".encode())
                loss = text if same else loss or ""
                loss_hash.update(loss.encode())
                for i, n in enumerate((1, len(loss), chars, attached, tokens)):
                    counts[i] += n
            if done:
                yield table(done, kind)
        if own:
            yield table([row()], kind)

    return ordered.mapInArrow(run, schema)


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<)(s>|/s>|[|](?:image|audio|document|endoftext)[|]>|<SYS>>|</SYS>>)|([[])(INST[]]|/INST[]])', '\1\3\\\2\4', 'g') AS written,
    regexp_extract_all(text, '!\[[^\]\n]*\]\([^()\s]+\)|\[[^\]\n]*\]\([^()\s]+\.(?:mp3|wav|ogg|flac|pdf|docx?|odt)\)') AS attached FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(3 + length(role) + 6 + length(written) + 4)::BIGINT AS formatted_chars, sum(len(attached))::BIGINT AS n_attachments, sum(len(attached))::BIGINT AS expanded_tokens
FROM w GROUP BY conv_id"""

NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
