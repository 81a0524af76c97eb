"""Grammars of filters, sorts, modifiers, pipelines and expressions, parsed into plain dataclasses. No Spark here."""
