from tallyline.functions import arrays, names, text

__all__ = ["arrays", "names", "text"]
