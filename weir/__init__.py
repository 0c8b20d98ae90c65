"""weir: a small stream-analytics engine whose plans are ordinary Spark plans.

A :class:`Query` is an immutable list of steps (filter, map, select, key,
window, aggregate, sink).  The same steps compile to a batch or a streaming
``DataFrame``; Catalyst picks the physical plan.
"""

from weir.functions.aggregates import Aggregation, Avg, Count, Max, Min, Sum
from weir.functions.mappers import Add, Concat, Divide, Mapper, Subtract
from weir.functions.predicates import (
    Equal,
    Greater,
    GreaterEqual,
    Less,
    LessEqual,
    Like,
    NotEqual,
    Predicate,
)
from weir.operators.windows import (
    Counter,
    CountTrigger,
    CountWindow,
    ProcessingTimeTrigger,
    PurgingTrigger,
    SessionEventTimeWindow,
    SessionProcessingTimeWindow,
    SlidingEventTimeWindow,
    SlidingProcessingTimeWindow,
    Time,
    TumblingEventTimeWindow,
    TumblingProcessingTimeWindow,
    Window,
)
from weir.plans.config import Config
from weir.plans.query import Query
from weir.plans.schema import DataType, Field, Schema, SourceType
from weir.sources.readers import InputType

__all__ = [
    "Add", "Aggregation", "Avg", "Concat", "Config", "Count", "CountTrigger", "CountWindow",
    "Counter", "DataType", "Divide", "Equal", "Field", "Greater", "GreaterEqual", "InputType",
    "Less", "LessEqual", "Like", "Mapper", "Max", "Min", "NotEqual", "Predicate",
    "ProcessingTimeTrigger", "PurgingTrigger", "Query", "Schema", "SessionEventTimeWindow",
    "SessionProcessingTimeWindow", "SlidingEventTimeWindow", "SlidingProcessingTimeWindow",
    "SourceType", "Subtract", "Sum", "Time", "TumblingEventTimeWindow",
    "TumblingProcessingTimeWindow", "Window",
]
