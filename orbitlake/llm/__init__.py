"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
in :mod:`orbitlake.llm.registry` list what the driver entry point registers.
"""
