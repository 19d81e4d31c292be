"""What a Python worker process remembers from task to task.

Workers outlive the tasks and operators they serve, so a process keeps the memory of one
operator only: the next one's takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_of_process: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned for this key, unless another operator has been here since."""
    if key not in _of_process:
        forget()
        _of_process[key] = make()
    return _of_process[key]


def forget() -> None:
    """For operators that remember nothing: drops what the one before remembered."""
    if _of_process:
        _of_process.clear()
        pa.default_memory_pool().release_unused()
