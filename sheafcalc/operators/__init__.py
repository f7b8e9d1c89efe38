"""Operators on cells and findings: references, graph, recalculation, rules, pricing and ranking."""
