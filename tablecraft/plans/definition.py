"""What a model's body means, as text: equal for equal code in every process."""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import functools
import inspect
import re
import types
from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column


class DefinitionError(TypeError):
    """A body depends on a value that has no description, so a change of it could not be noticed."""


#: Packages whose objects are means to compute with, not part of what is computed.
_MEANS = ("pyspark", "py4j", "tablecraft.plans.project", "tablecraft.sources", "logging")
_PLAIN = (str, bytes, bool, int, float, complex, type(None), Decimal, dt.date, dt.time, dt.timedelta, type(Ellipsis))


def code_text(function: Any, variables: Mapping[str, Any] | None = None) -> str:
    """Bytecode, constants, defaults and closure values of a function.

    Functions that it reaches by closure or by a global name (macros among them, also
    as ``module.macro``) are included, and so are the values of ``variables`` that
    its constants name. Dataclasses and other objects count by their class and their
    fields, sessions, frames, projects and warehouses by their class alone. A value that has
    neither is refused.
    """
    seen: dict[int, int] = {}
    return _value(function, variables or {}, seen)


def _value(value: Any, variables: Mapping[str, Any], seen: dict[int, int]) -> str:
    if isinstance(value, types.CodeType):
        return _code(value, variables, seen)
    if isinstance(value, _PLAIN):
        used = f"={variables[value]!r}" if isinstance(value, str) and value in variables else ""
        return repr(value) + used
    if isinstance(value, (tuple, list)):
        return "[" + ",".join(_value(v, variables, seen) for v in value) + "]"
    if isinstance(value, (set, frozenset)):
        return "{" + ",".join(sorted(_value(v, variables, seen) for v in value)) + "}"
    if isinstance(value, Mapping):
        return "{" + ",".join(f"{_value(k, variables, seen)}:{_value(v, variables, seen)}" for k, v in value.items()) + "}"
    value = inspect.unwrap(value) if callable(value) else value
    if isinstance(value, types.MethodType):
        value = value.__func__
    if not isinstance(value, types.FunctionType):
        return _object(value, variables, seen)
    if id(value) in seen:
        return f"<function {seen[id(value)]}>"
    seen[id(value)] = len(seen)
    cells = [_cell(c) for c in value.__closure__ or ()]
    names = _names(value.__code__)
    reached = {n: value.__globals__[n] for n in sorted(names) if n in value.__globals__}
    outside = []
    for name, found in reached.items():
        if isinstance(found, types.ModuleType):
            macros = {n: getattr(found, n) for n in sorted(names) if hasattr(getattr(found, n, None), "__wrapped__")}
            outside.append(f"{name}:{_value(macros, variables, seen)}")
        elif not isinstance(found, type):
            outside.append(f"{name}:{_value(found, variables, seen)}")
    parts = [_code(value.__code__, variables, seen), _value(value.__defaults__, variables, seen), _value(value.__kwdefaults__, variables, seen),
             _value(cells, variables, seen), ";".join(outside)]
    return "(" + "|".join(parts) + ")"


def _object(value: Any, variables: Mapping[str, Any], seen: dict[int, int]) -> str:
    if isinstance(value, type):
        return f"<class {value.__module__}.{value.__qualname__}>"
    name = f"{type(value).__module__}.{type(value).__qualname__}"
    if isinstance(value, Column):
        return f"{name}:{re.sub('#[0-9]+', '', str(value))}"
    if isinstance(value, enum.Enum):
        return f"{name}.{value.name}"
    if isinstance(value, functools.partial):
        return f"{name}({_value((value.func, value.args, value.keywords), variables, seen)})"
    if isinstance(value, re.Pattern):
        return f"{name}({value.pattern!r},{value.flags})"
    if isinstance(value, range):
        return repr(value)
    if isinstance(value, (types.BuiltinFunctionType, types.MethodDescriptorType, types.ModuleType)):
        return f"<{getattr(value, '__module__', None)}.{getattr(value, '__qualname__', value.__name__)}>"
    if name.startswith(tuple(f"{m}." for m in _MEANS)) and not name.startswith("pyspark.sql.types."):
        return name
    if id(value) in seen:
        return f"<object {seen[id(value)]}>"
    seen[id(value)] = len(seen)
    if dataclasses.is_dataclass(value):
        fields = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)}
    else:
        slots = [s for kind in type(value).__mro__ for s in getattr(kind, "__slots__", ()) if s not in ("__dict__", "__weakref__")]
        fields = {**{s: getattr(value, s) for s in slots if hasattr(value, s)}, **getattr(value, "__dict__", {})}
        if not slots and not hasattr(value, "__dict__"):
            raise DefinitionError(f"a model body depends on a value of type {name}, which cannot be described; use plain values, dataclasses or variables")
    return f"{name}{_value(dict(sorted(fields.items())), variables, seen)}"


def _cell(cell: Any) -> Any:
    try:
        return cell.cell_contents
    except ValueError:  # not filled yet
        return None


def _code(code: types.CodeType, variables: Mapping[str, Any], seen: dict[int, int]) -> str:
    return "|".join([code.co_code.hex(), repr(code.co_names), repr(code.co_varnames), _value(code.co_consts, variables, seen)])


def _names(code: types.CodeType) -> set[str]:
    found = set(code.co_names)
    for constant in code.co_consts:
        if isinstance(constant, types.CodeType):
            found |= _names(constant)
    return found
