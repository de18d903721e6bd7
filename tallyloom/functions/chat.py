"""Chat templates as data: how messages become one prompt, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import FORBIDDEN


@dataclass(frozen=True)
class ChatTemplate:
    """Each message is its role's header, its content and ``close``.

    ``names``: how roles are called where not by their own name; ``fold_system``: a leading system message goes before the first
    other message's content, with a blank line; ``default_system`` stands first where no system message leads; ``trim``: contents
    lose white space at both ends.
    """

    header: str  # {role} stands for the role
    close: str
    begin: str = ""
    names: dict[str, str] = field(default_factory=dict)
    fold_system: bool = False
    default_system: str | None = None
    trim: bool = False

    def _head(self, role: Column) -> Column:
        name = role
        for old, new in self.names.items():
            name = F.when(role == old, new).otherwise(name)
        before, after = self.header.split("{role}")
        return F.concat(F.lit(before), name, F.lit(after))

    def render(self, messages: Column, generation: bool = True) -> Column:
        """``messages``: an array of structs (role, content), in order. With ``generation`` the answer's header ends the prompt.

        A forbidden token in the result fails the query. Null messages render to null, null contents as empty.
        """
        white = " \t\n\r\x0b\x0c"
        content = lambda m: F.btrim(F.coalesce(m["content"], F.lit("")), F.lit(white)) if self.trim else F.coalesce(m["content"], F.lit(""))
        first = F.get(messages, 0)
        led = F.coalesce(first["role"] == "system", F.lit(False))
        shown = messages
        if self.fold_system:
            shown = F.when(led, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
            lead = F.when(led, F.concat(content(first), F.lit("\n\n"))).otherwise("")
        elif self.default_system is not None:
            lead = F.when(led, "").otherwise(F.concat(self._head(F.lit("system")), F.lit(self.default_system + self.close)))
        else:
            lead = F.lit("")
        inner = lambda m, i: F.when(i == 0, F.concat(lead, content(m))).otherwise(content(m)) if self.fold_system else content(m)
        turns = F.array_join(F.transform(shown, lambda m, i: F.concat(self._head(m["role"]), inner(m, i), F.lit(self.close))), "")
        parts = [F.lit(self.begin)] + ([] if self.fold_system else [lead]) + [turns] + ([self._head(F.lit("assistant"))] if generation else [])
        whole = F.concat(*parts)
        return F.when(F.contains(whole, F.lit(FORBIDDEN)), F.raise_error(F.lit("forbidden token in prompt")).cast("string")).otherwise(whole)


#: Three public shapes of chat templates.
TEMPLATES = {
    "im": ChatTemplate("<|im_start|>{role}\n", "<|im_end|>\n", default_system="You are a helpful assistant."),
    "header": ChatTemplate("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", begin="<|begin_of_text|>", trim=True),
    "turn": ChatTemplate("<start_of_turn>{role}\n", "<end_of_turn>\n", begin="<bos>", names={"assistant": "model"}, fold_system=True, trim=True),
}
