"""Memory that the driver holds but does not use."""

import re
from pathlib import Path

import pytest

from pixelloom.llm import tables


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's figures")
def test_the_driver_gives_back_what_its_jvm_freed_outside_the_heap(spark):
    """Space of codecs, of which every tenth stays, so that what is freed has no common end."""
    jvm = spark._jvm
    own = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", own.read_text())[1]) / 1024
    jvm.System.gc()
    some = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for k, x in enumerate(some):
        if k % 10:
            x.end()
    for _ in range(6):  # until the heap itself is as small as it gets
        jvm.System.gc()
    before = held()
    tables.free_shuffles(spark)
    after = held()
    assert before - after > 40
    for x in some[::10]:
        x.end()
