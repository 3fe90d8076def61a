from tallyline.sources import csv_files, jdbc, pk_list, scripts

__all__ = ["csv_files", "jdbc", "pk_list", "scripts"]
