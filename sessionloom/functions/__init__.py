from .draws import keyed_draw
from .rules import RulePath, flatten_rules
from .ticks import number_line, tick_of, tick_start, utc
from .wire import fields, strip_wire

__all__ = ["RulePath", "fields", "flatten_rules", "keyed_draw", "number_line", "strip_wire", "tick_of", "tick_start", "utc"]
