"""XPath 1.0 over the node table."""

from treeframe.xpath.plan import compile_xpath, evaluate, select

__all__ = ["compile_xpath", "evaluate", "select"]
