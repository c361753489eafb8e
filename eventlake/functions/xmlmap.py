"""Flatten XML text to a map. Element names are not known up front, which built-ins need."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def xml_to_map(text: Column) -> Column:
    """MAP of leaf paths and attributes, NULL when the text is not well-formed XML."""

    # nested, so it travels to executors by value
    def flatten(doc):
        from xml.etree import ElementTree

        if doc is None:
            return None
        try:
            root = ElementTree.fromstring(doc)
        except ElementTree.ParseError:
            return None
        out: dict[str, str] = {}
        stack = [(root, root.tag.rsplit("}", 1)[-1])]
        while stack:
            node, path = stack.pop()
            for name, value in node.attrib.items():
                out[f"{path}_{name.rsplit('}', 1)[-1]}"] = value
            children = list(node)
            if children:
                stack.extend((child, f"{path}.{child.tag.rsplit('}', 1)[-1]}") for child in reversed(children))
            elif node.text and node.text.strip():
                out[path] = node.text.strip()
        return out

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(flatten)

    return F.pandas_udf(convert, T.MapType(T.StringType(), T.StringType()))(text)
