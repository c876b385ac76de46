"""A conversation's facts, kept as state of a stream of turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "conv_id bigint, age string, duration string, taking string, asked_about string, risks string, flagged boolean, history array<struct<role:string,text:string>>, n_turns bigint, seen bigint"
#: What a store of several states for each key needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOINT = ","


class Session(StatefulProcessor):
    """The state of one conversation: values for what is held back and what came first, a sticky flag, maps of names and
    risks by their first turn, and a list of the latest turns."""

    def __init__(self, taking: str, medicine: str, age: str, duration: str, risks: dict[str, str], flag: str | None, cuts: tuple[int, int], latest: int):
        self.taking, self.medicine, self.age, self.duration, self.risks, self.flag, self.cuts, self.most = taking, medicine, age, duration, risks, flag, cuts, latest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "turn bigint, text string")
        self.first = handle.getValueState("first", "age_turn bigint, age string, duration_turn bigint, duration string, n_turns bigint, seen bigint")
        self.flagged = handle.getValueState("flagged", "flagged boolean")
        self.seen = {name: handle.getMapState(name, "name string", "turn bigint") for name in ("taken", "asked", "found")}
        self.history = handle.getListState("history", "turn bigint, role string, text string")

    def note(self, kind: str, name: str, turn: int) -> None:
        state, key = self.seen[kind], (name,)
        if not state.containsKey(key) or state.getValue(key)[0] > turn:
            state.updateValue(key, (turn,))

    def fold(self, turn: int, text: str, first: list) -> None:
        """One user turn that another has followed."""
        first[4] += 1
        for at, pattern in ((0, self.age), (2, self.duration)):
            if (m := re.search(pattern, text)) and (first[at] < 0 or turn < first[at]):
                first[at : at + 2] = [turn, m[0]]
        if m := re.search(self.medicine, text):
            self.note("taken" if re.search(self.taking, text) else "asked", m[0], turn)
        for kind, pattern in self.risks.items():
            if re.search(pattern, text):
                self.note("found", kind, turn)
                if kind == self.flag:
                    self.flagged.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, said = self.now.get() if self.now.exists() else (-1, None)
        first = list(self.first.get()) if self.first.exists() else [-1, None, -1, None, 0, 0]
        latest = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        for batch in rows:
            for turn, role, text in batch[["turn", "role", "text"]].itertuples(index=False):
                if role not in ("user", "assistant"):
                    continue
                text, first[5] = text or "", first[5] + 1
                latest.append((int(turn), role, text[: self.cuts[role != "user"]]))
                if len(latest) > 4 * self.most:
                    latest = sorted(latest)[-self.most - 1 :]
                if role == "user":
                    if turn > now:
                        turn, text, now, said = now, said, int(turn), text
                    if turn >= 0:
                        self.fold(int(turn), text, first)
        # One more than are shown: the turn that is held back may be among them.
        latest = sorted(latest)[-self.most - 1 :]
        if now >= 0:
            self.now.update((now, said))
        self.first.update(tuple(first))
        if latest:
            self.history.put(latest)
        if now >= 0:
            names = {kind: JOINT.join(sorted(k[0] for k in state.keys())) for kind, state in self.seen.items()}
            shown = [{"role": r, "text": t} for turn, r, t in latest if not (r == "user" and turn == now)][-self.most :]
            flagged = bool(self.flagged.exists() and self.flagged.get()[0])
            yield pd.DataFrame({"conv_id": [key[0]], "age": [first[1]], "duration": [first[3]], "taking": [names["taken"]], "asked_about": [names["asked"]], "risks": [names["found"]], "flagged": [flagged], "history": [shown], "n_turns": [first[4]], "seen": [first[5]]})

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, taking: str, medicine: str, age: str, duration: str, risks: dict[str, str], flag: str | None = None, cuts: tuple[int, int] = (800, 1200), latest: int = 8) -> DataFrame:
    """The facts of each conversation after each batch of turns(conv_id, turn, role, text), as operators.conversation's
    `session` finds them over all turns so far: the last user turn is held back until another one follows.

    `seen` counts the turns so far and says which of a conversation's rows is the last. Turns may come in any order. The state of a conversation does not grow with its length, but for the names in it.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = Session(taking, medicine, age, duration, risks, flag, cuts, latest)
    return turns.groupBy("conv_id").transformWithStateInPandas(own, OUTPUT, "append", "none")
