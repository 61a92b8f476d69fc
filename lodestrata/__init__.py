"""lodestrata: declarative corpus analytics compiled to Spark DataFrame plans.

The core never imports the ``llm`` subpackage; that one builds on the core.
"""
