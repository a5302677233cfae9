"""Sources and sinks: frames from files and bundles, probe metadata, locators, reports."""
