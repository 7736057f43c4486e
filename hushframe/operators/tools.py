"""Presets: what each tool finds, and what it hides unless told otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import rules as R
from .redact import redact

#: Categories of tags that the tools for pictures add or move.
PICTURE_TAGS = {"FACE": "faces", "USERNAME": "tech"}
SECRET_TAGS = {
    "API_KEY": "secrets",
    "TOKEN": "secrets",
    "PASSWORD": "secrets",
    "PRIVATE_KEY": "secrets",
    "CONNECTION": "secrets",
    "SECRET": "secrets",
    "HOST": "tech",
}


@dataclass(frozen=True)
class Tool:
    """Categories that are hidden, further categories that can be, tags with a category of
    their own, and the style of masking."""

    on: tuple[str, ...]
    off: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    style: str = "labels"

    @property
    def category_of(self) -> dict[str, str]:
        return R.CATEGORY_OF | self.tags

    def redact(self, df: DataFrame, text: str = "text", out: str = "masked", on: list[str] | None = None, **options) -> DataFrame:
        """Adds ``out``, the masked copy; ``on`` replaces the categories hidden. A category that
        the tool does not have raises ValueError."""
        chosen = list(self.on if on is None else on)
        if unknown := set(chosen) - {*self.on, *self.off}:
            raise ValueError(f"no such category: {sorted(unknown)}")
        return redact(df, self.style, text, out, enabled=chosen, category_of=self.category_of, **options)


#: What is on at first in each tool.
TEXT = Tool(("name", "org", "place", "contact", "date", "finance", "id", "tech"), ("other",))
CHAT = Tool(("name", "contact", "place", "finance", "id"), ("org", "date", "tech", "other"), style="fake")
SCREENSHOT = Tool(("name", "faces", "contact", "tech", "secrets", "place", "org", "finance", "id"), ("date",), PICTURE_TAGS | SECRET_TAGS)
CHAT_SCREENSHOT = Tool(("name", "faces", "contact", "tech", "place", "org", "finance", "id"), ("date",), PICTURE_TAGS, style="fake")
RECORDING = Tool(("name", "contact", "secrets", "tech", "finance", "id", "place", "org", "faces"), ("date",), PICTURE_TAGS | SECRET_TAGS)
TOOLS = {"text": TEXT, "chat": CHAT, "pdf": TEXT, "screenshot": SCREENSHOT, "chat_screenshot": CHAT_SCREENSHOT, "recording": RECORDING}
