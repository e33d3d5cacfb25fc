"""Field definitions: the columns of a collection, described as data."""

from __future__ import annotations

from dataclasses import dataclass, field as _field, replace

# The field types.
FIELD_TYPES = ("text", "number", "price", "date", "url", "image", "email", "phone", "attribute", "html")
NUMERIC_TYPES = ("number", "price")


@dataclass(frozen=True)
class Locator:
    """Where a value sits inside an item.

    ``steps`` is a chain of child steps (``tag`` or ``tag[n]``); an anchored chain
    starts at the item itself, any other chain may start anywhere below it.
    """

    css: str
    scope: bool = False
    anchored: bool = False
    tag: str | None = None
    elem_id: str | None = None
    attr: str | None = None
    val: str | None = None
    classes: tuple[str, ...] = ()
    steps: tuple[str, ...] = ()

    @staticmethod
    def item() -> "Locator":
        return Locator(":scope", scope=True)

    @staticmethod
    def by_class(tag: str, *classes: str) -> "Locator":
        return Locator(tag + "".join(f".{c}" for c in classes), tag=tag, classes=classes)

    @staticmethod
    def by_attr(tag: str, attr: str, val: str) -> "Locator":
        return Locator(f'{tag}[{attr}="{val}"]', tag=tag, attr=attr, val=val)

    @staticmethod
    def by_tag(tag: str) -> "Locator":
        return Locator(tag, tag=tag)

    @staticmethod
    def by_path(*steps: str) -> "Locator":
        css = " > ".join([":scope", *(s.replace("[", ":nth-of-type(").replace("]", ")") for s in steps)])
        return Locator(css, anchored=True, tag=steps[-1].split("[")[0], steps=steps)


@dataclass(frozen=True)
class Field:
    id: str
    name: str
    type: str = "text"
    locators: tuple[Locator, ...] = _field(default_factory=lambda: (Locator.item(),))
    attribute: str | None = None
    pattern: str | None = None
    pattern_flags: str | None = None
    multiple: bool = False
    required: bool = False
    hidden: bool = False
    explanation: str | None = None
    confidence: float | None = None

    def __post_init__(self):
        if self.type not in FIELD_TYPES:
            raise ValueError(f"unknown field type {self.type!r}")


def visible(fields: list[Field]) -> list[Field]:
    return [f for f in fields if not f.hidden]


def unique_names(fields: list[Field]) -> list[Field]:
    """Refuse two visible fields of one name: a keyed export would keep only one."""
    names = [f.name for f in visible(fields)]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate field names: {repeated}")
    return fields


# -- edits to a column set (rename, retype, move, hide, delete, add, re-point) --


def rename(fields: list[Field], field_id: str, name: str) -> list[Field]:
    return [replace(f, name=name[:80]) if f.id == field_id else f for f in fields]


def retype(fields: list[Field], field_id: str, type: str) -> list[Field]:
    return [replace(f, type=type) if f.id == field_id else f for f in fields]


def move(fields: list[Field], field_id: str, offset: int) -> list[Field]:
    at = next(i for i, f in enumerate(fields) if f.id == field_id)
    to = at + offset
    if not 0 <= to < len(fields):
        return fields
    moved = list(fields)
    moved[at], moved[to] = moved[to], moved[at]
    return moved


def toggle_hidden(fields: list[Field], field_id: str) -> list[Field]:
    return [replace(f, hidden=not f.hidden) if f.id == field_id else f for f in fields]


def delete(fields: list[Field], field_id: str) -> list[Field]:
    return [f for f in fields if f.id != field_id]


def add_custom(fields: list[Field], field_id: str) -> list[Field]:
    return [*fields, Field(field_id, f"Field {len(fields) + 1}")]


def repoint(fields: list[Field], field_id: str, locator: Locator, type: str | None = None,
            attribute: str | None = None) -> list[Field]:
    """Point a field at another place; its fallbacks and its pattern no longer apply."""
    def changed(f: Field) -> Field:
        return replace(f, locators=(locator,), pattern=None, pattern_flags=None,
                       type=type or f.type, attribute=attribute if type else f.attribute)

    return [changed(f) if f.id == field_id else f for f in fields]
