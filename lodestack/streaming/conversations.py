"""The form of each conversation carried through a stream of messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.chat import BLANK, FIELDS, FORM_COLUMNS, LISTS, carried, outcome_of, said_in


class CarriedForm(StatefulProcessor):
    """Per conversation: the form so far, as JSON, for ``hours`` after its last message."""

    def __init__(self, conversation: str, turn: str, hours: float):
        self.conversation, self.turn, self.hours = conversation, turn, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", "form string", ttlDurationMs=int(self.hours * 3_600_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        form = json.loads(self.form.get()[0]) if self.form.exists() else BLANK
        out = []
        for t in pd.concat(list(rows)).sort_values([self.turn, "said_text"], kind="stable").to_dict("records"):
            said = t | {f: list(t[f]) for f in (*LISTS, "notes")} | {f: None if pd.isna(t[f]) else int(t[f]) for f in FIELDS if f not in LISTS}
            said["years"] = [int(y) for y in said["years"]]
            form = carried(form, said)
            out.append({self.conversation: key[0], self.turn: t[self.turn], **outcome_of(form, said)})
        self.form.update((json.dumps(form),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def parsed_stream(turns: DataFrame, aliases: dict[str, str], conversation: str = "conv_id", turn: str = "turn", text: str = "text", hours: float = 24) -> DataFrame:
    """plans.chat.parse_conversations over a stream; the turns of a conversation arrive in order, several in one micro-batch
    are sorted. A conversation that is silent for ``hours`` starts anew. Needs the RocksDB state store."""
    kinds = dict(turns.dtypes)
    said = said_in(turns, aliases, conversation, turn, text)
    schema = f"{conversation} {kinds[conversation]}, {turn} {kinds[turn]}, {FORM_COLUMNS}"
    return said.groupBy(conversation).transformWithStateInPandas(CarriedForm(conversation, turn, hours), outputStructType=schema, outputMode="append", timeMode="ProcessingTime")
