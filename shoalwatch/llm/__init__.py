"""Training-data operators.

Nothing outside this subpackage imports it; ``shoalwatch.llm.queries`` holds
the registered queries.
"""
