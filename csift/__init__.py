"""csift: C source analysis as Spark queries."""

__version__ = "0.1.0"

_PUBLIC = {
    "Scan": "csift.plans.scan", "ScanConfig": "csift.plans.scan", "scan_files": "csift.plans.scan", "scan_path": "csift.plans.scan", "scan_text": "csift.plans.scan",
    "parsed": "csift.operators.parse", "relation": "csift.operators.parse", "register_views": "csift.operators.parse", "findings": "csift.operators.findings",
    "RULES": "csift.rules.catalog", "Rule": "csift.rules.catalog", "CustomRule": "csift.rules.custom", "register": "csift.rules.custom", "Config": "csift.sources.config",
    "load_config": "csift.sources.config", "IgnoreRules": "csift.sources.ignore",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        import importlib

        return getattr(importlib.import_module(_PUBLIC[name]), name)
    raise AttributeError(name)
